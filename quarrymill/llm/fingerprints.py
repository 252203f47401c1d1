"""Canonical exact digests of documents, in DataFrame operations only.

A text is canonicalised (Unicode NFKC, full case folding, NFKC again, white space runs to one space, trimmed) and hashed to
128 bits by two seeded xxHash64. Texts whose hashes are equal are then compared byte by byte; should different texts meet in
a bucket, a number after the digest tells them apart. Normalisation and folding are ICU's, which Spark ships, called through
Spark's SQL function `reflect`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, keep_ids, parts, written

#: Buckets of documents in doc_id order for each shuffle partition (several, so that partitions get about as much), and at most;
#: their first ids are all that the driver gets.
BUCKETS, MOST_BUCKETS = 4, 1 << 17
_LOW = -(1 << 63)


def canonical(text: Column) -> Column:
    """The canonical form; text must not be null."""
    icu = lambda cls, method, c: F.call_function("reflect", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), c, F.lit(True))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)))
    return F.trim(F.regexp_replace(folded, r"[\p{Z}\s\x{85}]+", " "))


def digest(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(0x51AB), canon)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by binary search."""
    steps, width = [], 1
    while width <= len(bounds):
        steps.insert(0, width)
        width *= 2
    if not steps:
        return F.lit(0)
    table = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda i, s: F.when((i + s <= len(bounds)) & (F.get(table, F.least(i + s, F.lit(len(bounds))) - 1) <= key), i + s).otherwise(i))


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (o, text and other columns) with next_<c> of the row that follows in the order of o and text; after the last: the first.

    Rows are bucketed by quantiles of o and ordered within buckets, so no task sees all rows but those of one o (null ids among
    them), which are ordered in one task, on disk if need be. The first row of each bucket also goes, marked, to the end of the
    bucket before."""
    spark, buckets = docs.sparkSession, min(BUCKETS * parts(docs.sparkSession), MOST_BUCKETS)
    cuts = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(docs.agg(F.percentile_approx("o", F.lit(cuts).cast("array<double>"), F.lit(max(10_000, 4 * buckets))).alias("b")).first().b or [])) if cuts else []
    dealt = docs.withColumn("b", _bucket(F.col("o"), bounds))
    firsts = sorted((r.b, r.o) for r in dealt.select("b", "o").groupBy("b").agg(F.min("o").alias("o")).collect())
    if not firsts:
        return dealt.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).drop("b")
    heads = [(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)]
    marks = F.broadcast(spark.createDataFrame(heads, "o long, to int"))
    others = [c for c in docs.columns if c not in ("o", "text")]
    first = dealt.join(marks, "o").groupBy("to", "o").agg(F.min_by(F.struct("text", *others), "text").alias("x")).select(F.col("to").alias("b"), "o", "x.*")
    both = dealt.select("b", "o", "text", *others, F.lit(0).alias("mark")).unionByName(first.select("b", "o", "text", *others, F.lit(1).alias("mark")))
    w = Window.partitionBy("b").orderBy("mark", "o", "text")
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("mark = 0").drop("mark", "b")


def edited(text: Column, n: Column, following: Column) -> Column:
    """The last quarter (rounded down) of the code points replaced by as many of the next text's first."""
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def _split(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("o"), F.coalesce("text", F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, hashed: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (1.0 where fingerprints are equal, else 0.0: the
    digest is exact by design, and tells only whether canonical forms are the same). hashed: two longs of a canonical form.

    Null text: empty. Null doc_id: first in the order. Rows of one doc_id: in the order of their texts. A single row is its own
    next. Other columns are ignored."""
    base = _split(docs).select("o", "text", canonical(F.col("text")).alias("canon")).select("o", "text", F.xxhash64("text").alias("t"), *(h.alias(f"h{k}") for k, h in enumerate(hashed(F.col("canon")))))
    found = with_next(base, "o", "t", "text", "h0", "h1").withColumn("n", F.length("text")).withColumn("edited", edited(F.col("text"), F.col("n"), F.col("next_text")))
    found = found.withColumn("canon", canonical(F.col("edited")))
    table = written(found.select("o", "t", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "h0", "h1", *(h.alias(f"e{k}") for k, h in enumerate(hashed(F.col("canon")))), "next_o", "next_t", F.col("next_h0").alias("x0"), F.col("next_h1").alias("x1")), "digests")
    ranks = collisions(docs, table, hashed)
    name = lambda a, b, r: F.concat(F.lower(F.lpad(F.hex(a), 16, "0")), F.lower(F.lpad(F.hex(b), 16, "0")), F.when(r > 0, F.concat(F.lit("-"), r.cast("string"))).otherwise(""))
    own = ed = nxt = F.lit(0)
    out = table
    if ranks is not None:
        # each side is looked up by its row and hash; only rows of mixed buckets are in `ranks`
        for kind, key, h in (("own", ("o", "t"), "h"), ("edited", ("o", "t", "next_o", "next_t"), "e"), ("own", ("next_o", "next_t"), "x")):
            side = ranks.where(F.col("kind") == kind).select(*[F.col(c).alias(f"r{k}") for k, c in enumerate(("o", "t", "next_o", "next_t")[: len(key)])], F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("rank").alias(f"rank_{h}"))
            same = (F.col(f"{h}0") == F.col("ra")) & (F.col(f"{h}1") == F.col("rb"))
            for k, c in enumerate(key):
                same = same & (F.col(c) == F.col(f"r{k}"))
            out = out.join(side, same, "left").drop("ra", "rb", *[f"r{k}" for k in range(len(key))])
        own, ed, nxt = (F.coalesce(f"rank_{h}", F.lit(0)) for h in "hex")
    c = F.col
    same = lambda a, b: (a == b).cast("double")
    return out.select(F.when(c("o") != _LOW, c("o")).alias("doc_id"), c("n").cast("long").alias("n_chars"), "edited_sha256", name(c("h0"), c("h1"), own).alias("fingerprint"), name(c("e0"), c("e1"), ed).alias("edited_fingerprint"), name(c("x0"), c("x1"), nxt).alias("next_fingerprint")).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same(c("fingerprint"), c("edited_fingerprint")).alias("near_edited"), same(c("fingerprint"), c("next_fingerprint")).alias("near_next"))


def collisions(docs: DataFrame, table: DataFrame, hashed: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame | None:
    """Compares the canonical bytes of all texts that share a bucket: kind, o and t (and next_o and next_t of edited ones), a, b, rank
    of rows in buckets that hold several texts; None if there is no such bucket. Only texts of buckets with two rows or more are
    read again, and copies of one text meet in the map side of the aggregation."""
    c = F.col
    rows = table.select("o", "t", "next_o", "next_t", F.explode(F.array(F.struct(F.lit("own").alias("kind"), c("h0").alias("a"), c("h1").alias("b")), F.struct(F.lit("edited").alias("kind"), c("e0").alias("a"), c("e1").alias("b")))).alias("r")).select("o", "t", "next_o", "next_t", "r.*")
    # written first, so that both sides of the join are plain and Spark can split a digest that very many rows have
    shared = written(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "shared")
    suspects = written(rows.join(shared, ["a", "b"]), "suspects")
    dropped(shared, release=False)
    texts = _split(docs).withColumn("t", F.xxhash64("text"))
    own = keep_ids(texts, suspects.where("kind = 'own'").select("o").distinct(), "o").select(F.lit("own").alias("kind"), "o", "t", F.lit(0).cast("long").alias("next_o"), F.lit(0).cast("long").alias("next_t"), canonical(c("text")).alias("canon"))
    pairs = suspects.where("kind = 'edited'").select("o", "t", "next_o", "next_t").distinct()
    left = keep_ids(texts, pairs.select("o").distinct(), "o").dropDuplicates(["o", "t"])
    right = keep_ids(texts, pairs.select(c("next_o").alias("o")).distinct(), "o").dropDuplicates(["o", "t"]).select(c("o").alias("next_o"), c("t").alias("next_t"), c("text").alias("following"))
    ed = left.join(pairs, ["o", "t"]).join(right, ["next_o", "next_t"]).select(F.lit("edited").alias("kind"), "o", "t", "next_o", "next_t", canonical(edited(c("text"), F.length("text"), c("following"))).alias("canon"))
    a, b = hashed(c("canon"))
    found = own.unionByName(ed).select("kind", "o", "t", "next_o", "next_t", "canon", a.alias("a"), b.alias("b"))
    mixed = found.groupBy("a", "b").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low != high").select("a", "b")
    mixed = written(mixed, "mixed")
    if not mixed.limit(1).count():
        dropped(suspects, mixed, release=False)
        return None
    inside = found.join(mixed, ["a", "b"])
    ranked = inside.select("a", "b", "canon").distinct().select("*", (F.row_number().over(Window.partitionBy("a", "b").orderBy("canon")) - 1).alias("rank"))
    return inside.join(ranked, ["a", "b", "canon"]).select("kind", "o", "t", "next_o", "next_t", "a", "b", "rank").distinct()
