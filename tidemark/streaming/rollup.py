"""Bucket aggregates that follow a growing series.

Each micro-batch is reduced to partial aggregates, which are written under its
own number; reading merges them.  Nothing is held as state, late points need no
watermark, and a batch that is run again overwrites what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import workspace
from tidemark.operators import buckets


def fresh(spark: SparkSession) -> str:
    """An unused path in the shared folder."""
    return workspace.fresh(spark, "rollup")


def follow(series: DataFrame, width: int, origin: int, path: str) -> None:
    """Takes in what a streaming series (ts_ms, id, value) holds and hasn't been taken in, and returns."""

    def take(batch: DataFrame, number: int) -> None:
        buckets.aggregate(batch, width, origin).write.mode("overwrite").parquet(f"{path}/parts/batch={number}")

    series.writeStream.foreachBatch(take).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, path: str) -> DataFrame:
    """aggregate() of all points taken in."""
    return buckets.roll_up(spark.read.parquet(f"{path}/parts").drop("batch"), 1)
