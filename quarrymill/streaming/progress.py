"""The progress of training runs as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import PROGRESS


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON messages that runs add to a folder."""
    return spark.readStream.schema(PROGRESS).json(folder)


def latest(rows: DataFrame) -> DataFrame:
    """Each run's last step, its mean loss and number of steps. Works on a stream (update mode) and on a table."""
    return rows.groupBy("run").agg(F.max_by("epoch", "ts").alias("epoch"), F.max_by("map50", "ts").alias("map50"), F.avg("loss").alias("mean_loss"), F.count("*").alias("steps"))


def per_window(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Steps and mean loss by run and window of time; state of windows older than `late` is dropped."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "run").agg(F.count("*").alias("steps"), F.avg("loss").alias("mean_loss"))


def last_status(rows: DataFrame) -> DataFrame:
    """Each run's last status and when it came."""
    return rows.groupBy("run").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def stopped(query: StreamingQuery, drain: bool = False) -> None:
    """Stops a stream; with drain what has come is read to its end first, else what is left waits for the stream's next start."""
    if drain and query.isActive:
        query.processAllAvailable()
    query.stop()
    query.awaitTermination()
