"""Reductions of a series to the pixel columns of a viewport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import buckets


def points(table: DataFrame, kinds: tuple[str, ...] = ("first", "min", "max", "last")) -> DataFrame:
    """(id, b, ts_ms, value), each distinct point of the given kinds of four_points()."""
    each = F.array(*(F.struct(F.col(f"{k}_ms").alias("ts_ms"), F.col(f"{k}_v").alias("value")) for k in kinds))
    return table.select("id", "b", F.inline(F.array_distinct(each)))


def columns(series: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """four_points() by pixel column; a rest narrower than a column is left out."""
    step = (high - low) // width
    inside = series.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < low + step * width))
    return buckets.four_points(inside, step, low)


def pixel(value: Column, low: Column, high: Column, height: int) -> Column:
    """Pixel row of a value; 0 if all values are equal."""
    return F.when(high > low, ((height - 1) * (value - low) / (high - low)).cast("int")).otherwise(0)


def summary(table: DataFrame) -> DataFrame:
    """(id, columns, mn, mx, total) with total the sum of min + max of each column."""
    return table.groupBy("id").agg(F.count("*").alias("columns"), F.min("min_v").alias("mn"), F.max("max_v").alias("mx"), F.sum(F.col("min_v") + F.col("max_v")).alias("total"))


def raster(series: DataFrame, low: int, high: int, width: int, height: int) -> DataFrame:
    """(id, px, py) of the pixels that the vertical extent of each column covers."""
    table = columns(series, low, high, width)
    extent = table.groupBy("id").agg(F.min("min_v").alias("lo"), F.max("max_v").alias("hi"))
    x = table.join(extent, "id")
    at = lambda c: pixel(F.col(c), F.col("lo"), F.col("hi"), height)
    return x.select("id", F.col("b").alias("px"), F.explode(F.sequence(at("min_v"), at("max_v"))).alias("py"))


def pixel_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, wrong, either): pixels in one raster only, and in any."""
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("id", "px", "py").agg(F.sum("s").alias("s"))
    return both.groupBy("id").agg(F.sum((F.col("s") != 3).cast("long")).alias("wrong"), F.count("*").alias("either"))
