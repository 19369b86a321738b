"""Shapes from the rises and falls of smoothed bucket means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import patterns


def islands(df: DataFrame, new: Column, name: str, *order: str) -> DataFrame:
    """df with the running number of the stretch of rows, by id, that a true `new` begins."""
    return df.withColumn("_new", new).withColumn(name, F.sum(F.coalesce("_new", F.lit(True)).cast("int")).over(Window.partitionBy("id").orderBy(*order))).drop("_new")


def rises_and_falls(table: DataFrame, least: float) -> DataFrame:
    """(id, b, to, rises): stretches of aggregate() over which the mean of three buckets rises or falls by `least` at least.

    Smaller moves are passed over, and stretches of one direction that then
    meet become one.
    """
    by = Window.partitionBy("id").orderBy("b")
    t = table.select("id", "b", (F.col("sm") / F.col("n")).alias("y"))
    t = t.select("id", "b", F.avg("y").over(by.rowsBetween(-1, 1)).alias("y"))
    t = t.select("id", "b", "y", F.lead("y").over(by).alias("y2"), F.lead("b").over(by).alias("b2")).where("y2 <> y").withColumn("rises", F.expr("y2 > y"))
    t = islands(t, F.lag("rises").over(by) != F.col("rises"), "g", "b")
    t = t.groupBy("id", "g").agg(F.min("b").alias("b"), F.max("b2").alias("to"), F.first("rises").alias("rises"), F.abs(F.sum(F.col("y2") - F.col("y"))).alias("d")).where(F.col("d") >= least)
    t = islands(t, F.lag("rises").over(by) != F.col("rises"), "k", "b")
    return t.groupBy("id", "k").agg(F.min("b").alias("b"), F.max("to").alias("to"), F.first("rises").alias("rises")).select("id", "b", "to", "rises")


#: Runs of a shape, the longest first; those of two or four begin with a rise, but for the valley.
RUNS = (("sawtooth", 8), ("double_peak", 4), ("triangle", 2))


def candidates(table: DataFrame, least: float) -> DataFrame:
    """(id, b, to, shape) at each stretch: the longest shape that begins with it; a fall begins a v_shape only."""
    by = Window.partitionBy("id").orderBy("b")
    end = lambda k: F.lead("to", k - 1).over(by)
    t = rises_and_falls(table, least).select("id", "b", "rises", *(end(k).alias(name) for name, k in RUNS))
    shape = F.when(~F.col("rises"), "v_shape").when(F.col("sawtooth").isNotNull(), "sawtooth").when(F.col("double_peak").isNotNull(), "double_peak").otherwise("triangle")
    to = F.when(shape == "sawtooth", F.col("sawtooth")).when(shape == "double_peak", F.col("double_peak")).otherwise(F.col("triangle"))
    return t.where("triangle IS NOT NULL").select("id", "b", to.alias("to"), shape.alias("shape"))


def shapes(table: DataFrame, least: float) -> DataFrame:
    """(id, b, to, shape): candidates() taken from the left without overlap; a shape may begin where the one before ends.

    Stretches alternate, so each candidate skips a fixed number of them: which
    are taken follows from one walk over an id's stretches.
    """
    return patterns.without_overlap(candidates(table, least))
