"""Where intermediate tables are cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder that spark.checkpoint.dir names.

    Only a session whose executors live in the driver may go without the
    setting, as in tests; a cluster would write to folders that its other
    machines can't see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back, with the columns as they were."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. DataFrames that read them can't be used any more."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)
