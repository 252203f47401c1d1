"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of every file is addressed by the SHA-256 of its content. The ledger holds a row for each pair of a blob and a
rule version that was scanned, with what was found; a run scans only blobs that the ledger lacks under the current rules,
each once however many paths and versions hold it, adds them, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh_dir, written

#: kind, pattern, group whose length counts (0: the match), least length. The first three are the base rules.
#: A run of 24 or more is what is left of `[0-9a-f]+` when shorter ones are dropped, and so with AKIA; the value of an
#: assignment is taken as it is and measured afterwards, for a short one still uses up its characters.
RULES = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE = 3
#: Found blobs up to this number are broadcast to redact texts; more are joined by a shuffle.
BROADCAST_BLOBS = 20_000
#: Code points of the parts in which texts with secrets are read.
PART = 1024
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def matches_of(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """One rule's matches in order: the code points between each and the one before, its own, and whether it is long enough."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len")))
    rows = F.zip_with(sized, own, lambda x, o: F.struct(F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["len"].alias("len"), (F.length(o) >= least).alias("counts")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind_no:int,kind:string,gap:int,len:int,counts:boolean>>"))


def found_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, spans (sorted by start, then rule) of blobs (blob, content: unique, dealt by blob). Places are running sums over a blob's
    matches of a rule, so a text with many secrets takes time that grows with their number; only matches are sorted, not texts."""
    every = F.concat(*[matches_of(F.col("content"), k, *rule) for k, rule in enumerate(rules)])
    rows = blobs.select("blob", F.posexplode_outer(every).alias("at", "m")).select("blob", "at", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob", "kind_no").orderBy("at")).cast("int")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    spans = F.collect_list(F.when(F.col("counts"), F.struct("start", "kind_no", "end", "kind")))
    return placed.groupBy("blob").agg(F.array_sort(spans).cast(SPAN).alias("spans"))


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class BlobLedger:
    """The ledger in a folder that driver and executors share. Runs are added as Parquet folders that count once complete, so a
    run that breaks off leaves nothing; a pair that two runs scanned at once counts once."""

    def __init__(self, spark: SparkSession, folder: str, rules=RULES):
        self.spark, self.rules, self.version = spark, rules, rule_version(rules)
        self.folder = f"{folder}/rules={self.version}"

    def _runs(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        disk = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not disk.exists(path):
            return []
        found = [s.getPath() for s in disk.listStatus(path)]
        return sorted(p.toString() for p in found if disk.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    SCHEMA = f"blob string, spans {SPAN}"

    def entries(self) -> DataFrame:
        """blob and spans (sorted by start, then rule) of every pair scanned under the current rules."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        found = self.spark.read.schema(self.SCHEMA).parquet(*runs)
        return found if len(runs) == 1 else found.dropDuplicates(["blob"])

    def add(self, contents: DataFrame) -> str:
        """Scans the texts (column `content`) whose blobs are unseen. Copies meet in the map side of the aggregation, so the text
        of a blob is moved once for each task that holds it."""
        text = F.coalesce(F.col("content"), F.lit(""))
        blobs = contents.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
        if self._runs():
            blobs = blobs.join(self.entries().select("blob"), "blob", "left_anti")
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        found_spans(blobs, self.rules).write.parquet(path)
        return path

    def scan(self, versions: DataFrame) -> DataFrame:
        """versions: `content` and any key columns, a row for each version of each path. Returns the key columns, blob, spans; where a
        key column has such a name, these have a line after theirs (`spans_`)."""
        self.add(versions.select("content"))
        keys, tag = [c for c in versions.columns if c != "content"], uuid.uuid4().hex
        free = lambda name: free(name + "_") if name.lower() in {c.lower() for c in keys} else name
        own = versions.select(*[F.col(f"`{c}`") for c in keys], F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("b" + tag))
        entries = self.entries().where(F.size("spans") > 0).select(F.col("blob").alias("f" + tag), F.col("spans").alias("s" + tag))
        return own.join(entries, F.col("b" + tag) == F.col("f" + tag), "left").select(*[F.col(f"`{c}`") for c in keys], F.col("b" + tag).alias(free("blob")), F.coalesce("s" + tag, F.array().cast(SPAN)).alias(free("spans")))


def secret_scan(docs: DataFrame, folder: str | None = None, rules=RULES) -> DataFrame:
    """Findings of every document: doc_id, n_<base kind>, base_sha256, spans.

    Null text: empty, nothing found. Null doc_id and repeated rows: each has its row. Without a folder the ledger starts
    empty in a new folder under spark.checkpoint.dir."""
    spark = docs.sparkSession
    found = BlobLedger(spark, folder or fresh_dir(spark, "ledger"), rules).scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("content")))
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    of = lambda k: F.filter("spans", lambda s: s["kind_no"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{rule[0]}") for k, rule in enumerate(rules[:BASE])]
    return found.select("doc_id", *counts, F.sha2(written_spans(base).cast("binary"), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))


def between(parts: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of a text that is cut into parts of PART: reads these parts alone."""
    first, last = F.floor(begin / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    one = F.substring(F.get(parts, first), begin - first * PART + 1, end - begin)
    more = F.concat(F.substring(F.get(parts, first), begin - first * PART + 1, F.lit(PART)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(F.get(parts, last), F.lit(1), end - last * PART))
    return F.when(end <= begin, "").when(first == last, one).otherwise(more)


def redacted(docs: DataFrame, folder: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, with each found span (overlapping ones together) replaced by the mark and n_chars counted anew.

    Null texts and repeated rows stay as they are; time grows with a text's length and its number of secrets, not with their product."""
    spark = docs.sparkSession
    ledger = BlobLedger(spark, folder or fresh_dir(spark, "ledger"))
    ledger.add(docs.select(F.col("text").alias("content")))
    b, s = "b" + uuid.uuid4().hex, "s" + uuid.uuid4().hex
    spans = ledger.entries().select("blob", F.inline("spans"))
    passed = F.coalesce(F.max("end").over(Window.partitionBy("blob").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = F.collect_list(F.when(F.col("start") >= F.col("passed"), F.struct("passed", "start")))  # of text before each mark
    found = written(spans.withColumn("passed", passed).groupBy(F.col("blob").alias(b + "f")).agg(F.array_sort(gaps).alias(s), F.max("end").alias(s + "e")), "redactions")
    if found.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
        found = F.broadcast(found)
    text, parts = F.col("text"), F.col(s + "p")
    cut = F.when(F.col(s).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))
    out = docs.withColumn(b, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(found, F.col(b) == F.col(b + "f"), "left").withColumn(s + "p", cut)
    marked = F.transform(F.col(s), lambda g: F.concat(between(parts, g["passed"], g["start"]), F.lit(mark)))
    new = F.when(F.col(s).isNull(), text).otherwise(F.concat(F.array_join(marked, ""), between(parts, F.col(s + "e"), F.length(text))))
    out = out.withColumn(s + "t", new)
    cols = [F.col(s + "t").alias("text") if c == "text" else F.when(F.col(s).isNull(), F.col("n_chars")).otherwise(F.length(s + "t")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
 ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 6),
 ('access', 1, 'AKIA([A-Z0-9]+)', 16), ('hex', 2, '()[0-9a-f]{24,}', 0),
 ('private_key', 3, '()-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0),
 ('jwt', 4, '()eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0),
 ('forge_token', 5, '()gh[pousr]_[A-Za-z0-9]{36,}', 0)) AS k(kind, no, p, least)),
m AS (
 SELECT doc_id, kind, no, least, regexp_extract_all(t, p) AS a, string_split_regex(t, p) AS g,
  CASE no WHEN 0 THEN regexp_extract_all(t, p, 2) WHEN 1 THEN regexp_extract_all(t, p, 1) ELSE regexp_extract_all(t, p, 0) END AS o
 FROM d, k WHERE regexp_matches(t, p)),
e AS (SELECT doc_id, kind, no, least, i, a[i] AS a, o[i] AS o, sum(length(g[i]) + length(a[i])) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop
 FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
s AS (SELECT doc_id, kind, no, stop - length(a) AS start, stop FROM e WHERE length(o) >= least),
f AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) FILTER (no < 3) AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id
"""
