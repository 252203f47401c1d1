"""Removal of lines that many documents share.

Lines are normalised, hashed to 128 bits, and the distinct documents of each hash are counted. A document sends each of its keys
once, with the place where it first has it. Keys over the threshold are written, and joined with the places; the places come back
to their documents, which drop those lines and the equal ones. The joins are merges of plain tables at every size, so that what is
moved grows as the input does: a text once, a line by its hashes, ids and place; and Spark can split a line that very many
documents hold.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import dropped, small_batches, written
from .tokens import slices

_TAIL = re.compile(rb"[\x80-\xbf]")
#: Stands for a null doc_id: below all others.
_LOW = -(1 << 63)

KEYS = T.StructType([T.StructField(c, t) for c, t in (("a", T.LongType()), ("b", T.LongType()), ("doc", T.LongType()), ("o", T.LongType()), ("at", T.IntegerType()))])
OUT = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept", T.StringType()))])


def key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A to Z in lower case: all that bytes.strip() and bytes.lower() do."""
    return line.strip().lower()


def _rows(docs: DataFrame) -> DataFrame:
    """doc (null: least), text (null: empty) and o, a hash of both: rows that share it are equal."""
    small_batches(docs.sparkSession)
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))
    return docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(doc, text, F.lit(12)).alias("o"))


def keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """A row for each distinct key of `least_chars` code points or more of each document: its hash (a, b), document, row and first
    place."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, docs, rows_, places = [], [], [], []
                for doc, text, o in zip(*(part.column(i).to_pylist() for i in range(3))):
                    first = {}
                    for at, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
                        if len(line) >= least_chars:
                            first.setdefault(line.strip(), at)
                    found = [(k, at) for k, at in first.items() if len(k) >= least_chars and (k.isascii() or len(k) - len(_TAIL.findall(k)) >= least_chars)]
                    hashes += [xxhash.xxh3_128_digest(k) for k, _ in found]
                    places += [at for _, at in found]
                    docs += [doc] * len(found)
                    rows_ += [o] * len(found)
                if hashes:
                    both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(rows_, pa.int64()), pa.array(places, pa.int32())], names=KEYS.names)

    return rows.select("doc", "text", "o").mapInArrow(run, KEYS)


def shared_keys(found: DataFrame, least_docs: int) -> DataFrame:
    """a, b and the largest document of keys that `least_docs` documents or more hold. A document counts once however many rows it
    has. Keys meet by key and document first, so a key that most documents hold is spread, and is then one row a task."""
    once = found.select("a", "b", "doc").distinct()
    return once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least_docs).select("a", "b", "last")


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept of every row: lines (split at \\n) whose key has `least_chars` code points or more and is
    found in `least_docs` documents or more go, but for those of the largest doc_id that holds the key; the others stay as they
    are, joined by \\n.

    Null and empty texts: one empty line. Rows of one doc_id are one document, and each loses or keeps its lines. Rows without
    doc_id are one document, below all others. An empty table gives an empty result; other columns are ignored. Keys are compared
    by 128-bit hashes. A task holds one document's lines at a time."""
    rows = _rows(docs)
    found = written(keys(rows, least_chars), "line-keys")
    shared = written(shared_keys(found, least_docs), "shared-lines")
    gone = found.join(shared.hint("merge"), ["a", "b"]).where("doc != last")
    places = written(gone.groupBy("o").agg(F.sort_array(F.collect_set("at")).alias("places")), "line-places")
    dropped(found, shared)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in OUT.fields]
                for doc, text, found in zip(*(part.column(i).to_pylist() for i in range(3))):
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    kept = lines
                    if found:
                        drop = {key(lines[at]) for at in found}
                        kept = [x for x in lines if key(x) not in drop]
                    for col, x in zip(out, (None if doc == _LOW else doc, len(lines), len(lines) - len(kept), b"\n".join(kept))):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()).cast(pa.string())], names=OUT.names)

    marked = rows.join(places.hint("merge"), "o", "left").select("doc", "text", "places")
    return marked.mapInArrow(run, OUT)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, s.last IS NOT NULL AND s.last != k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
