"""Long-format series: (ts TIMESTAMP, ts_ms LONG, id STRING, value DOUBLE), one row for each time and measure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_long(df: DataFrame, ts: str, measure: str, value: str) -> DataFrame:
    """Null values and timestamps are no points."""
    kept = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    return kept.select(F.col(ts).alias("ts"), F.expr(f"unix_micros(cast(`{ts}` AS timestamp)) div 1000").alias("ts_ms"), F.col(measure).cast("string").alias("id"), F.col(value).cast("double").alias("value"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_long(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "value")


def from_wide(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row (keys, id, value) for each measure column."""
    return df.select(*keys, *(F.col(m).cast("double") for m in measures)).unpivot(list(keys), list(measures), "id", "value")


def from_csv(spark: SparkSession, path: str, ts: str, measures: Sequence[str], fmt: str | None = None) -> DataFrame:
    """A wide CSV file with a header, as a long series."""
    wide = spark.read.option("header", True).csv(path)
    when = F.to_timestamp(ts, fmt) if fmt else F.to_timestamp(ts)
    return from_long(from_wide(wide.withColumn("ts", when), ["ts"], measures), "ts", "id", "value")


@dataclass(frozen=True)
class Interval:
    """Half-open [low, high) in milliseconds."""

    low: int
    high: int

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError("interval ends before it begins")

    def overlaps(self, other: Interval) -> bool:
        return self.low < other.high and other.low < self.high

    def contains(self, ms: int) -> bool:
        return self.low <= ms < self.high

    def encloses(self, other: Interval) -> bool:
        return self.low <= other.low and other.high <= self.high

    def adjacent(self, other: Interval) -> bool:
        """One ends where the other begins."""
        return self.high == other.low or other.high == self.low

    def span(self, other: Interval) -> Interval:
        """The smallest interval that holds both."""
        return Interval(min(self.low, other.low), max(self.high, other.high))

    def share(self, other: Interval) -> float:
        """The part of this interval that the other covers; 0 for an empty one."""
        both = min(self.high, other.high) - max(self.low, other.low)
        return max(0, both) / (self.high - self.low) if self.high > self.low else 0.0

    def holds(self) -> Column:
        """Also says so of the timestamp column itself, which the file reader can use."""
        ms = F.col("ts_ms")
        at = lambda x: F.timestamp_micros(F.lit(x * 1000).cast("long"))
        return (ms >= self.low) & (ms < self.high) & (F.col("ts").cast("timestamp") >= at(self.low)) & (F.col("ts").cast("timestamp") < at(self.high))


def within(series: DataFrame, low: int, high: int) -> DataFrame:
    """Points of [low, high); where the series has its timestamp column, the file reader gets the range too."""
    if "ts" in series.columns:
        return series.where(Interval(low, high).holds())
    return series.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < high))


def scan(series: DataFrame, wanted: dict[str, Sequence[Interval]]) -> DataFrame:
    """Points of measures in intervals, by one filter; a point in two intervals comes once."""
    terms = [(F.col("id") == m) & i.holds() for m, intervals in wanted.items() for i in intervals]
    return series.where(reduce(or_, terms) if terms else F.lit(False)).select("ts_ms", "id", "value")


def metadata(series: DataFrame) -> DataFrame:
    """(id, n, first_ms, last_ms) of every measure."""
    return series.groupBy("id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
