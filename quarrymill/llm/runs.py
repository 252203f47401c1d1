"""Periodic runs of words: stretches that repeat themselves with some period, found by names of power-of-two windows.

Level 0 numbers the words of a text, so that equal words have one number. Level k + 1 numbers the pairs of level-k names 2^k words
apart, so that two windows of 2^(k+1) words have one name exactly if their words are equal (Karp, Miller and Rosenberg 1972): nothing
is hashed to a number that could collide, and no suffixes are sorted. Levels end where no window occurs twice.

How far two places of a text agree, to the right or to the left, is found by going down the levels once: a window that agrees is
taken and passed. A run of period p and length L has L - p places whose word is equal to the one p further on, one after the
other; so of places on a grid of L - p at least one is among them, for each p, and such a place is extended to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import documents
from .tokens import slices

#: Grid places that are looked at in one step: bounds the memory of a long text.
STEP = 1 << 20

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([pa.field(c, pa.int64()) for c in RUN.names])


def names(ids: np.ndarray) -> list[np.ndarray]:
    """Names of all windows of 1, 2, 4, ... words, up to the first level at which no window occurs twice."""
    levels, width = [ids], 1
    while len(levels[-1]) > width:
        low = levels[-1]
        pairs = low[:-width].astype(np.int64) * (int(low.max()) + 1) + low[width:]
        order = np.argsort(pairs, kind="stable")
        new = np.empty(len(pairs), bool)
        new[0] = True
        np.not_equal(pairs[order[1:]], pairs[order[:-1]], out=new[1:])
        if new.all():
            break
        level = np.empty(len(pairs), np.int32)
        level[order] = np.cumsum(new, dtype=np.int32) - 1
        levels.append(level)
        width *= 2
    return levels


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on (or, back: before them) are equal; a < b."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, level = 1 << k, levels[k]
        if back:
            inside = a - found >= width
            x, y = np.where(inside, a - found - width, 0), np.where(inside, b - found - width, 0)
        else:
            inside = b + found + width <= len(levels[0])
            x, y = np.where(inside, a + found, 0), np.where(inside, b + found, 0)
        found += np.where(inside & (level[x] == level[y]), width, 0)
    return found


def _grids(n: int, least: int, times: int):
    """(places, periods) to look at, in ascending order of periods, about STEP of them at once."""
    places, periods, held = [], [], 0
    for p in range(1, min(n // times, n - 1) + 1):
        own = np.arange(0, n - p, max(least, times * p) - p)
        places.append(own)
        periods.append(np.full(len(own), p))
        held += len(own)
        if held >= STEP:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period: a stretch whose smallest period is `period`, of at least
    `least` words and `times` (two or more) periods, that can't be extended to either side with that period.

    A stretch that has `times` >= 2 periods of p and a smaller period too is a run of that one (Fine and Wilf), with the same
    bounds; so of all periods found for one stretch the least is kept."""
    if times < 2 or least < times:
        raise ValueError("times: 2 at least; least: times at least")
    if len(ids) < least:
        return []
    levels = names(ids)
    # so many words at least occur twice, p apart, in a run of any period: a window of so many words and all shorter ones do
    if len(levels) < min(max(least, times * p) - p for p in range(1, least + 1)).bit_length():
        return []
    found: dict[tuple[int, int], int] = {}
    for at, p in _grids(len(ids), least, times):
        hit = ids[at] == ids[at + p]
        at, p = at[hit], p[hit]
        stop = at + p + agreement(levels, at, at + p)
        start = at - agreement(levels, at, at + p, back=True)
        enough = stop - start >= np.maximum(least, times * p)
        for s, e, q in zip(start[enough].tolist(), stop[enough].tolist(), p[enough].tolist()):
            found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    start, length, period = np.array(found).T
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return [w for w, inside in zip(words, np.cumsum(edges[:-1]).tolist()) if not inside]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly; of equal ones the first, then that of the least period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), strongest (null: no run) and collapsed (the words that no
    run holds after its first period, joined by one space) of every document.

    Words: runs of characters other than ASCII white space. Null and empty texts: no words, no runs. Null doc_id, repeated rows:
    rows like any other. An empty table gives an empty result; other columns are ignored. No rows are moved. A text of n words
    takes 4 * n * (levels) bytes, where the levels end at the longest window that occurs twice (log2 of n at most), besides its
    words, and STEP grid places at once."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in FOUND.fields]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.encode("utf-8", "surrogatepass").split()
                    found = runs(numbered(words), least, times) if len(words) >= least else []
                    best = strongest(found)
                    own = [dict(zip(RUN.names, r)) for r in found]
                    for col, x in zip(out, (doc, len(words), own, best and dict(zip(RUN.names, best)), b" ".join(collapsed(words, found)))):
                        col.append(x)
                types = [pa.int64(), pa.int64(), pa.list_(_RUN), _RUN]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), pa.array(out[4], pa.binary()).cast(pa.string())], names=FOUND.names)

    return documents(docs).mapInArrow(run, FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, chosen by the CRC-32 of doc_id, repeat a stretch of their words to the end: test
    cases of all periods in real texts. Those of null doc_id stay."""
    c = F.col
    h = F.crc32(c("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size("words"), F.floor(c("h") / 10)
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", h.alias("h"))
    chosen = F.coalesce(c("h") % 10 == 0, F.lit(False))
    rows = rows.select("doc_id", "text", "h", F.when(chosen, words).otherwise(F.array().cast("array<string>")).alias("words"))
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    rows = rows.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), a.alias("a"))
    rows = rows.withColumn("p", (1 + F.floor((c("n") - c("a")) / (3 + c("g") % 8))).cast("int"))
    place = lambda i: c("a") + (i - c("a")) % c("p")
    told = F.transform(F.sequence(F.lit(0), c("n") - 1), lambda i: F.get("words", F.when(i < c("a"), i).otherwise(place(i))))
    return rows.select("doc_id", F.when(c("n") > 0, F.array_join(told, " ")).otherwise(c("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, digests of all runs and of the collapsed text."""
    c = F.col
    lines: Column = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    best = [c(f"strongest.{x}").alias(x) for x in RUN.names]
    milli = F.expr("(1000 * strongest.length) div strongest.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(c("collapsed")).alias("collapsed_sha256"))
