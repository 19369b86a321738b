"""Aggregates of a series by buckets of time; all can be rolled up to wider buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeunits import bucket


#: Functions of aggregate_of(), by name.
FUNCTIONS = {
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "count": lambda: F.count("value"),
    "sum": lambda: F.sum("value"),
    "first": lambda: F.min(F.struct("ts_ms", "value"))["value"],
    "last": lambda: -F.max(F.struct(F.col("ts_ms"), (-F.col("value")).alias("value")))["value"],
}
#: Sets of functions that views, bounds and four-point reductions ask for.
SETS = {"extent": ("min", "max"), "bounds": ("min", "max", "count", "sum"), "points": ("min", "max", "first", "last", "count")}


def aggregate_of(series: DataFrame, width: int, origin: int, functions: Sequence[str]) -> DataFrame:
    """(id, b, and a column of each function's name); no function is an error, and so is an unknown one."""
    if not functions or (unknown := set(functions) - set(FUNCTIONS)):
        raise ValueError(f"no such functions: {sorted(unknown)}" if functions else "no functions to aggregate by")
    return series.groupBy("id", bucket(width, origin).alias("b")).agg(*(FUNCTIONS[f]().alias(f) for f in functions))


def aggregate(series: DataFrame, width: int, origin: int) -> DataFrame:
    """(id, b, mn, mx, n, sm)."""
    v = F.col("value")
    return series.groupBy("id", bucket(width, origin).alias("b")).agg(F.min(v).alias("mn"), F.max(v).alias("mx"), F.count(v).alias("n"), F.sum(v).alias("sm"))


def four_points(series: DataFrame, width: int, origin: int) -> DataFrame:
    """(id, b, n) and value and time of the first, last, smallest and largest point; ties go to the earliest time, then the smallest value."""
    at, v = F.col("ts_ms"), F.col("value")
    parts = {"first": F.min(F.struct(at, v)), "last": F.max(F.struct(at, -v)), "min": F.min(F.struct(v, at)), "max": F.max(F.struct(v, -at))}
    got = series.groupBy("id", bucket(width, origin).alias("b")).agg(F.count(v).alias("n"), *(x.alias(k) for k, x in parts.items()))
    return _points(got)


def _points(got: DataFrame) -> DataFrame:
    f = lambda s, i: F.col(s)[got.schema[s].dataType.names[i]]
    ends = [f("first", 0).alias("first_ms"), f("first", 1).alias("first_v"), f("last", 0).alias("last_ms"), (-f("last", 1)).alias("last_v")]
    extremes = [f("min", 1).alias("min_ms"), f("min", 0).alias("min_v"), (-f("max", 1)).alias("max_ms"), f("max", 0).alias("max_v")]
    return got.select("id", "b", "n", *ends, *extremes)


def regression_sums(series: DataFrame, width: int, origin: int) -> DataFrame:
    """(id, b, n, sx, sy, sxy, sxx, syy, mn, mx) with x = time in the bucket / width.

    x counts from the beginning of each bucket, so that sums stay exact enough
    however far from the origin it is; roll_up_sums() and slopes.runs() shift it.
    """
    x, y = F.pmod(F.col("ts_ms") - F.lit(origin), F.lit(width)) / F.lit(float(width)), F.col("value")
    sums = [F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")]
    return series.groupBy("id", bucket(width, origin).alias("b")).agg(F.count(y).alias("n"), *sums, F.min(y).alias("mn"), F.max(y).alias("mx"))


def _wider(times: int) -> Column:
    return F.floor(F.col("b") / times).cast("long").alias("b")


def roll_up(table: DataFrame, times: int) -> DataFrame:
    """aggregate() of buckets `times` as wide, from the narrow ones."""
    return table.groupBy("id", _wider(times)).agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("n").alias("n"), F.sum("sm").alias("sm"))


def roll_up_points(table: DataFrame, times: int) -> DataFrame:
    """four_points() of buckets `times` as wide."""
    parts = {
        "first": F.min(F.struct("first_ms", "first_v")),
        "last": F.max(F.struct(F.col("last_ms"), (-F.col("last_v")).alias("v"))),
        "min": F.min(F.struct("min_v", "min_ms")),
        "max": F.max(F.struct(F.col("max_v"), (-F.col("max_ms")).alias("t"))),
    }
    got = table.groupBy("id", _wider(times)).agg(F.sum("n").alias("n"), *(x.alias(k) for k, x in parts.items()))
    return _points(got)


def roll_up_sums(table: DataFrame, times: int) -> DataFrame:
    """regression_sums() of buckets `times` as wide, x in the wider unit."""
    k, d, n = float(times), F.pmod(F.col("b"), F.lit(times)).cast("double"), F.col("n")
    sx, sxy = F.col("sx") + d * n, F.col("sxy") + d * F.col("sy")
    sxx = F.col("sxx") + 2 * d * F.col("sx") + d * d * n
    sums = [(F.sum(sx) / k).alias("sx"), F.sum("sy").alias("sy"), (F.sum(sxy) / k).alias("sxy"), (F.sum(sxx) / (k * k)).alias("sxx"), F.sum("syy").alias("syy")]
    return table.groupBy("id", _wider(times)).agg(F.sum("n").alias("n"), *sums, F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def rank_sample(series: DataFrame, width: int, origin: int, low: int, high: int) -> DataFrame:
    """Points whose rank by hash within their bucket is in (low, high]: samples that can be extended."""
    h = F.pmod(F.pmod(F.col("ts_ms"), F.lit(2147483647)) * F.lit(2654435761), F.lit(2147483647))
    by = Window.partitionBy("id", "b").orderBy("h", "ts_ms", "value")
    got = series.withColumn("b", bucket(width, origin)).withColumn("h", h).withColumn("r", F.row_number().over(by))
    return got.where((F.col("r") > low) & (F.col("r") <= high)).select("id", "b", "ts_ms", "value", "r")


def dense(table: DataFrame, buckets: int) -> DataFrame:
    """table with a row for each of `buckets` buckets of each of its ids."""
    grid = table.select("id").distinct().withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return grid.join(table, ["id", "b"], "left")
