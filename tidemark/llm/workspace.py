"""Intermediate tables of the text operators, and joins that hot keys don't slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import clear, folder, fresh, written  # noqa: F401

#: A key is hot if it holds more than this share of the rows (and more than LEAST rows): fewer than 1 / SHARE keys can.
SHARE, LEAST = 1 / 2000, 64


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row for each value of `on` and says in `count` how many rows have it.

    total: the number of rows.  The hot keys are fewer than 1 / SHARE, whatever
    the input, so their part of the table is broadcast and their rows stay where
    they are; all others are shuffled, none of them in a large group.  Both
    inputs are read twice and should be written tables.  how: inner or left.
    """
    limit = max(LEAST, int(total * SHARE))
    if total <= limit:
        return rows.join(table, on, how).select(*_columns(rows, table, on))
    hot = F.broadcast(table.where(F.col(count) > limit))
    few = rows.join(hot, on)
    many = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(count) <= limit), on, how)
    columns = _columns(rows, table, on)
    return few.select(*columns).unionByName(many.select(*columns))


#: Bytes up to which small() broadcasts.
BROADCAST_BYTES = 32 << 20


def small(table: DataFrame, size: Column | int) -> DataFrame | None:
    """A written table marked for broadcast if its rows, `size` bytes each, add up to BROADCAST_BYTES at most; else None."""
    total = table.agg(F.sum((F.lit(size) if isinstance(size, int) else size).cast("long"))).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else None


def salted(rows: DataFrame, table: DataFrame, on: str, by: Column, total: int) -> DataFrame:
    """rows joined with a table that has one row for each value of `on`, for tables whose rows are too wide to broadcast.

    total: the number of rows.  Rows of a hot key are dealt by the hash `by`
    over as many parts as it has shares of the limit, and the table's row is
    sent to each part: that makes at most 2 / SHARE further rows.
    """
    limit = max(LEAST, int(total * SHARE))
    if total <= limit:
        return rows.join(table, on).select(*_columns(rows, table, [on]))
    parts = rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    parts = F.broadcast(parts.select(on, F.ceil(F.col("_n") / limit).alias("_parts")))
    n = F.coalesce("_parts", F.lit(1)).cast("int")
    left = rows.join(parts, on, "left").withColumn("_part", F.pmod(by, n).cast("int"))
    right = table.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [on, "_part"]).select(*_columns(rows, table, [on]))


def without(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows that have no row in a table as lookup() takes it."""
    limit = max(LEAST, int(total * SHARE))
    hot, others = table.where(F.col(count) > limit).select(*on), table.where(F.col(count) <= limit).select(*on)
    return rows.join(F.broadcast(hot), on, "left_anti").join(others, on, "left_anti").select(*rows.columns)


def _columns(rows: DataFrame, table: DataFrame, on: list[str]) -> list[str]:
    return [*rows.columns, *(c for c in table.columns if c not in on)]
