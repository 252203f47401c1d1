"""Removal of word windows that occur elsewhere, by level-wise doubling.

A window of W words can only occur twice if each window inside it does. So windows of about W/4 words are counted first, of
which one in each W-word window is enough: the one with the least hash, which equal windows choose at the same place. Where
one occurs twice, it is extended, to the right and to the left, to the windows of twice its length that hold it; where
those occur twice, to the windows of W words that hold them. A level that nothing survives ends the search. Each level
counts the survivors of the one before alone, so what is moved shrinks to the text that does repeat. The last level has
96-bit hashes.

Rows of equal text are one row with a count from the start: their words need no counting.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_IDS, GOLD, WordHashes, arrays, dropped, kept_in_worker, mix, trim, written
from .tokens import slices


def lengths(window: int) -> tuple[int, int, int]:
    """Words of the windows of each level: a quarter (rounded up), half (rounded up), all."""
    half = -(-window // 2)
    return -(-half // 2), half, window


def doubled(h: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Hashes of the n first windows that join the windows at i and i + shift."""
    return mix(mix(h[:n]) * GOLD + h[shift : shift + n])


def base_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` words, by doubling from single words."""
    h, have = mix(words), 1
    while have < length:
        step = min(have, length - have)
        h = doubled(h, step, len(h) - step)
        have += step
    return h


def spread(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or, of=np.maximum, greatest) of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = of(x[: len(x) - step], x[step:]), have + step
    return x


def least(h: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Places that hold the least value of some `width` neighbouring ones that start at a valid place. A place does if the greatest
    of its windows' least values is its own."""
    low = np.where(valid, spread(h, width), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((spread(np.concatenate([edge, low, edge]), width, np.maximum) == h) & (h != 0))


def keys(doc_id: Column, text: Column) -> tuple[Column, Column, Column]:
    """o (a hash of doc_id and text, by which rows are dealt: rows of one doc_id, or of none, stay apart), k and k2 (a 128-bit hash
    of the text)."""
    k, k2 = F.xxhash64(text), F.xxhash64(F.lit(77), text)
    return F.xxhash64(doc_id.isNull(), doc_id, k, k2), k, k2


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    """o, text ('' for null), k and k2, and other columns that are asked for."""
    text = F.coalesce("text", F.lit(""))
    o, k, k2 = keys(F.col("doc_id").cast("long"), text)
    return docs.select(o.alias("o"), text.alias("text"), k.alias("k"), k2.alias("k2"), *more)


def short(k: str):
    return (F.col(k).bitwiseAND(F.lit(0x7FFFFFFF))).cast("int")


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


GRAMS = "h long, r long, l long, o long, k int, pos int"


def grams(rows: DataFrame, window: int) -> DataFrame:
    """The chosen base windows: hash, hashes of the extensions to the right and to the left, row and place. An extension beyond
    the text has a hash that no other has."""
    base, half, _ = lengths(window)
    width = window - base + 1

    def run(batches):
        hashes = kept_in_worker(WordHashes)
        for batch in batches:
            for part in slices(batch):
                o, k, n, found = [], [], [], []
                for own, text, short_k in zip(*(part.column(i).to_pylist() for i in range(3))):
                    words = text.encode("utf-8", "surrogatepass").split()
                    if len(words) >= window:
                        found.append(hashes(words))
                        for col, x in zip((o, k, n), (own, short_k, len(words))):
                            col.append(x)
                if not found:
                    continue
                words, n = np.concatenate(found), np.array(n)
                stop = np.repeat(np.cumsum(n), n)  # the end of each word's document
                h = base_hashes(words, base)
                two = doubled(h, half - base, len(words) - half + 1)
                at = least(h, width, np.arange(len(words) - window + 1) + window <= stop[: len(words) - window + 1])
                doc = np.repeat(np.arange(len(n)), n)[at]
                o, k, pos = np.array(o, np.int64)[doc], np.array(k, np.int32)[doc], (at - (np.cumsum(n) - n)[doc]).astype(np.int32)
                alone = mix(o.view(np.uint64) ^ mix(pos.astype(np.uint64)))
                right = np.where(at + half <= stop[at], two[np.minimum(at, len(two) - 1)], alone)
                left = np.where(pos >= half - base, two[np.maximum(at - (half - base), 0)], ~alone)
                yield _batch(GRAMS, *[c.view(np.int64) if c.dtype == np.uint64 else c for c in (h[at], right, left, o, k, pos)])

    return rows.select("o", "text", short("k").alias("k")).mapInArrow(run, GRAMS)


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs twice or more. Counts are pre-aggregated and written; so the join's two sides are plain shuffles, of
    which Spark can split the partitions of hot keys."""
    twice = written(df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys), "twice")
    return df.join(twice, list(keys), "left_semi")


WINDOWS = "a long, b int, o long, at long"


def windows(rows: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """96-bit hashes (a, b) of the W-word windows around surviving places; at: k << 32 | place. places: o, k and an array of
    4 * place + 2 * (whether the extension to the right is repeated) + the same to the left."""
    base, half, _ = lengths(window)

    def run(batches):
        hashes = kept_in_worker(WordHashes)
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(4)]
                for o, text, k, found in zip(*(part.column(i).to_pylist() for i in range(3)), arrays(part.column(3))):
                    words = text.encode("utf-8", "surrogatepass").split()
                    n = len(words) - window + 1
                    if n < 1:
                        continue
                    marks = np.zeros(n + 1, np.int64)
                    p = found >> 2
                    # a window that starts at s holds [p, p + half) if s >= p + half - window, else [p + base - half, p + base)
                    for there, low, high in ((found & 2, p + half - window, p), (found & 1, p + base - window, p + base - half)):
                        low, high = np.maximum(low, 0), np.minimum(high, n - 1)
                        ok = (there != 0) & (low <= high)
                        np.add.at(marks, low[ok], 1)
                        np.add.at(marks, high[ok] + 1, -1)
                    at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                    if not len(at):
                        continue
                    first = hashes(words)
                    for col, stream in zip(out, (first, mix(first ^ GOLD))):
                        two = doubled(base_hashes(stream, base), half - base, len(words) - half + 1)
                        col.append(doubled(two, window - half, n)[at])
                    out[1][-1] = (out[1][-1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out[2].append(np.full(len(at), o, np.int64))
                    out[3].append((k << 32) + at)
                if out[0]:
                    cols = [np.concatenate(c) for c in out]
                    yield _batch(WINDOWS, *[c.view(np.int64) if c.dtype == np.uint64 else c for c in cols])

    near = rows.select("o", "text", short("k").alias("k"))
    if places.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # then no other text needs to be moved
        near = near.join(F.broadcast(places.select("o").distinct()), "o", "left_semi")
    return near.join(places, ["o", "k"]).select("o", "text", "k", "found").mapInArrow(run, WINDOWS)


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(copies, found). copies: k, k2, low (the least o) of texts that occur twice or more. found: o, k (short) and the sorted starts of
    repeated windows, of rows whose text is not a copy of an earlier row's."""
    rows = rows_of(docs)
    copies = written(rows.groupBy("k", "k2").agg(F.count("*").alias("n"), F.min("o").alias("low")).where("n > 1"), "copies")
    few = copies.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    own = rows.join(F.broadcast(copies) if few else copies, ["k", "k2"], "left").where("low is null or o = low")
    level1 = written(grams(own, window), "grams")
    level2 = written(repeated(level1, "h").select("r", "l", "o", "k", "pos"), "level2")
    dropped(level1)
    sides = level2.select("o", "k", "pos", F.explode(F.array(F.struct(F.col("r").alias("e"), F.lit(True).alias("right")), F.struct(F.col("l").alias("e"), F.lit(False).alias("right")))).alias("s")).select("o", "k", "pos", "s.e", "s.right")
    kept = repeated(sides, "e").groupBy("o", "k", "pos").agg(F.max("right").alias("r"), F.max(~F.col("right")).alias("l"))
    places = written(kept.groupBy("o", "k").agg(F.collect_list(F.col("pos").cast("long") * 4 + F.col("r").cast("long") * 2 + F.col("l").cast("long")).alias("found")), "places")
    dropped(level2)
    level3 = written(windows(own, places, window), "windows")
    dropped(places)
    found = written(repeated(level3, "a", "b").select("o", F.shiftright("at", 32).cast("int").alias("k"), F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("pos")).groupBy("o", "k").agg(F.array_sort(F.collect_list("pos")).alias("starts")), "repeats")
    dropped(level3)
    return copies, found


def kept_words(words: list[bytes], starts, window: int) -> list[bytes]:
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + window, len(words)), -1)
    return [w for w, c in zip(words, np.cumsum(covered[:-1]).tolist()) if not c]


def _marked(docs: DataFrame, rows: DataFrame, window: int, names: tuple[str, ...]) -> DataFrame:
    """rows with two columns: whether the text is a copy, and the starts of its repeated windows (null: none). names: of o, k and k2 in
    rows, then of the two."""
    copies, found = repeated_windows(docs, window)
    few = copies.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    c = copies.select(F.col("k").alias(names[1] + "c"), F.col("k2").alias(names[2] + "c"), F.lit(True).alias(names[3]))
    out = rows.join(F.broadcast(c) if few else c, (F.col(names[1]) == F.col(names[1] + "c")) & (F.col(names[2]) == F.col(names[2] + "c")), "left").drop(names[1] + "c", names[2] + "c")
    f = found.select(F.col("o").alias(names[0] + "f"), F.col("k").alias(names[1] + "f"), F.col("starts").alias(names[4]))
    add = lambda some: some.join(f, (F.col(names[0]) == F.col(names[0] + "f")) & (short(names[1]) == F.col(names[1] + "f")), "left").drop(names[0] + "f", names[1] + "f")
    if found.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return add(out)
    hit = F.broadcast(found.select(F.col("o").alias(names[0])).distinct())  # only texts of these rows are moved
    none = F.lit(None).cast(found.schema["starts"].dataType).alias(names[4])
    own = [F.col(f"`{c}`") for c in out.columns]
    return add(out.join(hit, names[0], "left_semi").select(*own)).unionByName(out.join(hit, names[0], "left_anti").select(*own, none))


def substring_dedup(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document: each word is removed that a window of `window` words covers
    whose words also start at any other place of any document, the same one included.

    Words: runs of characters other than ASCII white space. Null text: no words. Null doc_id and repeated rows: documents like
    any other, so a row that occurs twice, of `window` words or more, loses all words in both. Shorter texts keep theirs."""
    rows = rows_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in range(5)]
                for o, text, copy, starts in zip(*(part.column(i).to_pylist() for i in range(3)), arrays(part.column(3))):
                    words = text.encode("utf-8", "surrogatepass").split()
                    kept = words
                    if len(words) >= window:
                        kept = [] if copy else kept_words(words, starts, window) if starts is not None else words
                    data = b" ".join(kept)
                    for col, x in zip(out, (o, len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data)):
                        col.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                n = 5 if with_text else 4
                yield _batch(schema, *[pa.array(c, t) for c, t in zip(out[:n], types[:n])])

    marked = _marked(docs, rows, window, ("o", "k", "k2", "copy", "starts"))
    return marked.select("doc_id", "text", "copy", "starts").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs without repeated passages: the words that substring_dedup() removes go from every place. Texts that lose nothing stay as
    they are; others have their kept words joined by one space and n_chars counted anew; rows that keep no word go."""
    tag = uuid.uuid4().hex
    o, k, k2, copy, starts, new = (f"{x}{tag}" for x in ("o", "k", "h", "c", "s", "n"))
    rows = docs.withColumns(dict(zip((o, k, k2), keys(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))))

    @F.pandas_udf("string")
    def changed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, copies, starts in batches:
            out = []
            for t, copy, found in zip(texts, copies, starts):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                hit = len(words) >= window and (copy is True or found is not None)
                out.append((b"" if copy is True else b" ".join(kept_words(words, found, window))).decode("utf-8", "surrogatepass") if hit else None)
            trim()
            yield pd.Series(out, dtype=object)

    out = _marked(docs, rows, window, (o, k, k2, copy, starts)).withColumn(new, changed("text", copy, starts)).where(F.col(new).isNull() | (F.col(new) != ""))
    return out.select(*[F.coalesce(new, "text").alias("text") if c == "text" else F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, string_agg(x.t, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept
 FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM w) x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
