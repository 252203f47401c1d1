"""Audit of how filters interact: what each removes in every order in which they can be applied.

Each document has a mask: bit f is set if it fails filter f. In an order of the filters it is removed at the first step whose
filter it fails. A table made once tells that step for each mask and order (32 by 120 for five filters); the masks of a batch index
it, and np.bincount adds up removals by part, order and step, for all, good and toxic documents. Each task gives a row for each
part, order and step that it met; these partial arrays are summed. What comes out doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BROADCAST_IDS, dropped, small_batches, written
from .tokens import slices

LETTERS = "ABCDE"
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Parts whose arrays a task holds at once; then it hands them on and begins anew.
PARTS = 512

JUDGED = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("part", T.StringType()), ("mask", T.IntegerType()), ("a", T.LongType()), ("b", T.LongType()))])
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
PARTIAL = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in COUNTS)])


def orders(n: int) -> np.ndarray:
    """All orders of n filters, a row each: the filter of each step."""
    return np.array(list(permutations(range(n))), np.int64).reshape(-1, n)


def first_failures(n: int) -> np.ndarray:
    """[mask, order]: the step (from 0) of the first filter that the mask fails; n where it fails none."""
    failed = (np.arange(1 << n)[:, None, None] >> orders(n)[None]) & 1
    return np.where(failed.any(2), failed.argmax(2), n)


def text_failures(text: str) -> int:
    """Bits 0 to 3. A: under 100 words; B: fewer distinct words than 80 % of them; C: over 10 % of the code points are A to Z; D: holds
    any of # $ % & * |."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * (len(data) - len(data.translate(None, UPPER))) > 10 * len(text)) << 2 | (len(data) != len(data.translate(None, SIGNS))) << 3


def judged(docs: DataFrame, failures=text_failures) -> DataFrame:
    """doc_id, part (lang, null: empty), mask of the filters that look at one text, and a 128-bit hash (a, b) of the text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))

    def run(batches):
        for batch in batches:
            for own in slices(batch):
                texts = own.column(1).to_pylist()
                hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]), "<i8").reshape(-1, 2)
                masks = pa.array([int(failures(t)) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), masks, pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=JUDGED.names)

    return rows.mapInArrow(run, JUDGED)


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """doc_id, part and mask of judged rows, where `bit` of the mask is set if a smaller doc_id has the same text. Copies meet on the map
    side; texts with one doc_id are left out before the join, whose sides are written tables, so that Spark can split a text that
    very many rows have."""
    found = rows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "b", "low")
    copies = written(found, "copies")
    few = copies.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    later = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    return rows.join(F.broadcast(copies) if few else copies, ["a", "b"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << bit).otherwise(0)).alias("mask"))


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """rows: part, mask (bit f: fails the f-th of `letters`), good, toxic (booleans). A row for each part, order of the filters and step,
    with the counts of audited()."""
    n = len(letters)

    def partial(own: dict):
        order, first = orders(n), first_failures(n)
        steps = np.arange(n)
        for part, (hist, by_step) in own.items():
            fails = np.array([hist[(np.arange(1 << n) >> f & 1) == 1].sum() for f in range(n)])
            alone = hist[1 << np.arange(n)]
            removed = by_step[0, :, :n]
            shapley = np.zeros(n, np.int64)
            np.add.at(shapley, order, removed)
            kept = hist.sum() - np.cumsum(removed, axis=1)
            columns = (kept, removed, fails[order] - removed, alone[order], by_step[1, :, :n], by_step[2, :, :n], shapley[order])
            names = np.repeat(["".join(letters[f] for f in o) for o in order.tolist()], n)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(np.tile(steps + 1, len(order)), pa.int32()), *(pa.array(c.reshape(-1), pa.int64()) for c in columns)], names=PARTIAL.names)

    def run(batches):
        first, many = first_failures(n), len(orders(n))
        own: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            # a batch of few rows at a time: a row makes an entry for each order
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                coded = some.column(0).dictionary_encode()
                parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
                masks = some.column(1).to_numpy().astype(np.int64)
                hist = np.bincount(code * (1 << n) + masks, minlength=len(parts) << n).reshape(len(parts), 1 << n)
                place = (code[:, None] * many + np.arange(many)) * (n + 1) + first[masks]
                labels = [np.ones(len(masks), bool), *(some.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))]
                counts = [np.bincount(place[x].reshape(-1), minlength=len(parts) * many * (n + 1)).reshape(len(parts), many, n + 1) for x in labels]
                for k, part in enumerate(parts):
                    if part not in own:
                        own[part] = np.zeros(1 << n, np.int64), np.zeros((3, many, n + 1), np.int64)
                    held = own[part]
                    held[0][:] += hist[k]
                    for to, c in zip(held[1], counts):
                        to += c[k]
                if len(own) >= PARTS:
                    yield from partial(own)
                    own = {}
        yield from partial(own)

    found = rows.select("part", "mask", "good", "toxic").mapInArrow(run, PARTIAL)
    return found.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (a label of quality 1) and toxic (a label of toxic 1); without a label neither. Several labels of one doc_id: any."""
    hit = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(hit("quality").alias("good"), hit("toxic").alias("toxic"))
    own = written(own.where("good or toxic"), "audit-labels")
    no = F.lit(False)
    return rows.join(own, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang, null: empty), order of the filters A to E and step, zeros included, with counts of documents within the
    part: kept after the step, removed there, redundant (fail its filter, removed earlier), unique_fails (fail its filter alone),
    good_lost and toxic_lost (removed there, with label quality 1 or toxic 1) and shapley (removed by its filter in all orders).

    A to D: text_failures(). E: a smaller doc_id has the same text anywhere in the table, compared by a 128-bit hash. Null text:
    empty. Null doc_id: never fails E, is no smaller one, and has no label. Repeated rows: each counts, and none is a copy of a row
    of its own doc_id. An empty table gives an empty result; other columns are ignored."""
    rows = written(judged(docs), "audit")
    masked = with_copies(rows, LETTERS.index("E"))
    return audit(labelled(masked, labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS low FROM t GROUP BY t),
f AS (SELECT t.doc_id, t.part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 10 * length(t.t) AS c, regexp_matches(t.t, '[#$%&*|]') AS d, t.doc_id > e.low AS e
  FROM t JOIN e ON t.t = e.t),
b AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT f.part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
  count(*) FILTER (coalesce(b.good, false)) AS good, count(*) FILTER (coalesce(b.toxic, false)) AS toxic
  FROM f LEFT JOIN b ON f.doc_id = b.doc_id GROUP BY ALL),
x AS (SELECT unnest(range(0, 5)) AS f),
o AS (SELECT p.f AS f1, q.f AS f2, r.f AS f3, s.f AS f4, u.f AS f5 FROM x p JOIN x q ON q.f != p.f JOIN x r ON r.f NOT IN (p.f, q.f)
  JOIN x s ON s.f NOT IN (p.f, q.f, r.f) JOIN x u ON u.f NOT IN (p.f, q.f, r.f, s.f)),
s AS (SELECT f1, f2, f3, f4, f5, unnest([1, 2, 3, 4, 5]) AS step, unnest([f1, f2, f3, f4, f5]) AS f,
  unnest([0, 1 << f1, (1 << f1) + (1 << f2), (1 << f1) + (1 << f2) + (1 << f3), (1 << f1) + (1 << f2) + (1 << f3) + (1 << f4)]) AS before FROM o),
g AS (SELECT m.part, substr('ABCDE', f1 + 1, 1) || substr('ABCDE', f2 + 1, 1) || substr('ABCDE', f3 + 1, 1) || substr('ABCDE', f4 + 1, 1) || substr('ABCDE', f5 + 1, 1) AS filter_order,
  step, f, sum(n) FILTER (mask & (before + (1 << f)) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & (1 << f) != 0) AS removed,
  sum(n) FILTER (mask & before != 0 AND mask & (1 << f) != 0) AS redundant, sum(n) FILTER (mask = 1 << f) AS unique_fails,
  sum(m.good) FILTER (mask & before = 0 AND mask & (1 << f) != 0) AS good_lost, sum(m.toxic) FILTER (mask & before = 0 AND mask & (1 << f) != 0) AS toxic_lost
  FROM m, s GROUP BY ALL),
z AS (SELECT part, f, sum(removed) AS shapley FROM g GROUP BY part, f)
SELECT g.part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM g JOIN z ON g.part = z.part AND g.f = z.f
"""
