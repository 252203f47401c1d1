"""Documents to training sequences, in five stages. Each reads what the one before kept, and writes what it keeps.

1. quality_rules: documents that the base rules or a certified cutoff reject go.
2. near_dedup: of each class of near duplicates the row of the smallest doc_id stays.
3. substring_dedup: words of passages that occur in several places go; documents without a word left go.
4. secret_scans: found secrets are replaced by a mark.
5. best_fit_packing: the texts, tokenised and cut, are packed into sequences of 1024 tokens; each piece has its token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.llm import chosen_path, packing, quality, secrets, substrings
from quarrymill.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = "quality" + uuid.uuid4().hex
    judged = quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name)
    return judged.where(f"{name}.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of null doc_id stay. Of several rows of one doc_id all stay with their class's first."""
    found = chosen_path.near_duplicates(docs)
    gone = written(found.where("not kept").select("doc_id").distinct(), "gone")
    few = gone.limit(1_000_001).count() <= 1_000_000
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]
#: Certified cutoffs and tokenisation can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
