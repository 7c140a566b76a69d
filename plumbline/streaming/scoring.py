"""Scoring of query files as they arrive, with the same code as a batch."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.tables import query_field
from pyspark.sql import functions as F


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(query) lines of every text file that appears in a folder; blank lines and comments skipped."""
    lines = spark.readStream.text(folder)
    return lines.select(query_field(F.col("value")).alias("query")).where("query is not null")


def score_stream(queries: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and write it under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
