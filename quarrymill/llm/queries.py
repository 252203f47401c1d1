"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bitplane, chosen_path, fingerprints, interactions, lexicon, lines, packing, quality, runs, secrets, substrings, surrogates, toxicity


#: For tests and examples alone: set spark.quarrymill.surrogates.key to a secret.
EXAMPLE_KEY = "no secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quarrymill.surrogates.key", None) or EXAMPLE_KEY
    return surrogates.pseudonymised(table(spark, sf_dir, "documents"), key)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), "q")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.token_files(table(spark, sf_dir, "documents"))


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_decode(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_best_fit_packing, op4_secret_scan, op5_pii_surrogates, op6_quality_rules, op7_minhash_near_dedup, op8_token_files, op9_bpe_lexicon, op10_fingerprints, op11_periodic_runs, op12_line_dedup, op13_filter_interactions)}
ORACLES = {"op2_substring_dedup": substrings.ORACLE, "op4_secret_scan": secrets.ORACLE, "op7_minhash_near_dedup": chosen_path.ORACLE, "op12_line_dedup": lines.ORACLE, "op13_filter_interactions": interactions.ORACLE}
