"""Which pixels of a view may be wrong when its columns are drawn from wider or narrower groups than themselves.

A group is a stretch of time [f, t) of an id with its number of points n and
its smallest and largest one (mn at mn_ms, mx at mx_ms).  The view [low, high)
has `width` columns; a rest narrower than a column is left out.  Results have
one row for each id and column, px counting from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import visual


def groups_of_points(table: DataFrame, width: int, origin: int) -> DataFrame:
    """Groups from four_points(), whose extremes have true times."""
    f = F.lit(origin) + F.col("b") * width
    return table.select("id", f.alias("f"), (f + width).alias("t"), "n", F.col("min_v").alias("mn"), F.col("min_ms").alias("mn_ms"), F.col("max_v").alias("mx"), F.col("max_ms").alias("mx_ms"))


def groups_of_extents(table: DataFrame, width: int, origin: int) -> DataFrame:
    """Groups from aggregate(): extremes count as being in the middle. Buckets of a dense table that hold nothing are groups of no points."""
    f = F.lit(origin) + F.col("b") * width
    middle = f + F.floor(F.lit(width) / 2).cast("long")
    n = F.coalesce("n", F.lit(0)).cast("long").alias("n")
    return table.select("id", f.alias("f"), (f + width).alias("t"), n, "mn", middle.alias("mn_ms"), "mx", middle.alias("mx_ms"))


def filled(table: DataFrame, measure: str, first: int, count: int) -> DataFrame:
    """aggregate() of one measure with a row for each of `count` buckets from `first` on."""
    every = table.sparkSession.range(first, first + count).select(F.lit(measure).alias("id"), F.col("id").alias("b"))
    return every.join(table.drop("id"), "b", "left").select("id", "b", *(c for c in table.columns if c not in ("id", "b")))


def groups_of_raw(series: DataFrame) -> DataFrame:
    """Each point as a group of a millisecond."""
    at, v = F.col("ts_ms"), F.col("value")
    return series.select("id", at.alias("f"), (at + 1).alias("t"), F.lit(1).cast("long").alias("n"), v.alias("mn"), at.alias("mn_ms"), v.alias("mx"), at.alias("mx_ms"))


def routed(groups: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Groups with the columns (px, from c0 to c1) that they meet, within the view."""
    step = (high - low) // width
    px = lambda ms: F.floor((ms - F.lit(low)) / step).cast("int")
    first, last = F.greatest(px(F.col("f")), F.lit(0)), F.least(px(F.col("t") - 1), F.lit(width - 1))
    met = groups.where((F.col("t") > low) & (F.col("f") < low + step * width))
    met = met.withColumn("px", F.explode(F.sequence(first, last)))
    start = F.lit(low) + F.col("px").cast("long") * step
    return met.withColumns({"c0": start, "c1": start + step})


def columns(groups: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """(id, px, ...) of every column of every id: what drawing it and judging its error takes.

    known: some group meets it.  n, mn, mx, first and last (of the extremes
    that lie in it) with their times; of two at a time the smaller one counts.  gapless: the groups that lie in it
    wholly are one stretch [in0, in1), with extremes in_mn, in_mx.  left: the
    narrowest group that reaches over its beginning, if the stretch begins
    later (null: none); begins, ends: the narrowest group that covers its
    first, last moment.
    """
    g = routed(groups, low, high, width)
    inside = (F.col("f") >= F.col("c0")) & (F.col("t") <= F.col("c1"))
    holds = F.col("n") > 0
    drawn = lambda ms, v: F.when(holds & (F.col(ms) >= F.col("c0")) & (F.col(ms) < F.col("c1")), F.struct(F.col(ms).alias("ms"), F.col(v).alias("v")))
    low_, high_ = drawn("mn_ms", "mn"), drawn("mx_ms", "mx")
    narrow = F.struct((F.col("t") - F.col("f")).alias("size"), "f", "t", "mn", "mx")
    late = lambda p: F.when(p.isNotNull(), F.struct(p["ms"].alias("ms"), (-p["v"]).alias("v")))
    values = lambda pick: pick(F.coalesce(low_["v"], high_["v"]), F.coalesce(high_["v"], low_["v"]))
    t = g.groupBy("id", "px").agg(
        F.sum(low_.isNotNull().cast("long") + high_.isNotNull().cast("long")).alias("n"),
        F.min(values(F.least)).alias("mn"),
        F.max(values(F.greatest)).alias("mx"),
        F.min(F.least(F.coalesce(low_, high_), F.coalesce(high_, low_))).alias("first"),
        F.max(F.greatest(F.coalesce(late(low_), late(high_)), F.coalesce(late(high_), late(low_)))).alias("late"),
        F.min(F.when(inside, F.col("f"))).alias("in0"),
        F.max(F.when(inside, F.col("t"))).alias("in1"),
        F.sum(F.when(inside, F.col("t") - F.col("f"))).alias("covered"),
        F.min(F.when(inside & holds, F.col("mn"))).alias("in_mn"),
        F.max(F.when(inside & holds, F.col("mx"))).alias("in_mx"),
        F.min(F.when((F.col("f") <= F.col("c0")), narrow)).alias("begins"),
        F.min(F.when((F.col("t") >= F.col("c1")), narrow)).alias("ends"),
    )
    step = (high - low) // width
    grid = groups.select("id").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    last = F.when(F.col("late").isNotNull(), F.struct(F.col("late.ms").alias("ms"), (-F.col("late.v")).alias("v")))
    t = grid.join(t.withColumn("known", F.lit(True)).withColumn("last", last), ["id", "px"], "left")
    start = F.lit(low) + F.col("px").cast("long") * step
    gapless = F.coalesce(F.col("in1") - F.col("in0") == F.col("covered"), F.lit(False))
    left = F.when((F.col("in0") > start) & (F.col("begins.t") >= F.col("in0")), F.col("begins"))
    kept = ["id", "px", start.alias("c0"), (start + step).alias("c1"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("n", F.lit(0)).alias("n")]
    return t.select(*kept, "mn", "mx", "first", "last", gapless.alias("gapless"), "in0", "in1", "in_mn", "in_mx", left.alias("left"), "begins", "ends")


def _ordered(a: str | Column, z: str | Column) -> Column:
    """A range of pixel rows (a, z); null ends where either is unknown."""
    a, z = (F.col(x) if isinstance(x, str) else x for x in (a, z))
    known = a.isNotNull() & z.isNotNull()
    return F.struct(F.when(known, F.least(a, z)).alias("a"), F.when(known, F.greatest(a, z)).alias("z"))


def errors(table: DataFrame, height: int, exact: Column | None = None) -> DataFrame:
    """(id, px, c0, c1, known, missing, false_, error) from columns().

    error: the share of the column's pixels that may be wrong.  It is 0 for a
    column that holds no point or that is `exact`, and null where it can't be
    told: the groups inside have gaps, or none tells what joins it to a
    neighbour; an empty group over a boundary adds no rows.  false_: rows that
    the joining lines may draw wrongly; missing: rows that the true lines may
    cover and nothing else does.
    """
    t = table.withColumn("exact", exact if exact is not None else F.lit(False))
    whole, by = Window.partitionBy("id"), Window.partitionBy("id").orderBy("px")
    t = t.withColumns({"lo": F.min("mn").over(whole), "hi": F.max("mx").over(whole)})
    lo, hi = F.col("lo"), F.col("hi")
    pixel = lambda v: F.when(v.isNotNull(), visual.pixel(F.least(F.greatest(v, lo), hi), lo, hi, height))
    # Rows of the groups at both ends, then those of the neighbours beside them.
    t = t.withColumns({f"{g}_{c}": pixel(F.col(f"{g}.{c}")) for g in ("begins", "ends") for c in ("mn", "mx")})
    t = t.withColumns({"in_a": pixel(F.col("in_mn")), "in_z": pixel(F.col("in_mx")), "reached": F.col("left").isNotNull(), "begun": F.col("begins").isNotNull(), "ended": F.col("ends").isNotNull()})
    t = t.withColumn("joins", ~F.col("exact") & (F.col("n") > 0))
    near = ("joins", "first", "last", "reached", "begun", "ended", "begins_mn", "begins_mx", "ends_mn", "ends_mx")
    t = t.withColumns({f"{side}_{c}": f(c).over(by) for side, f in (("p", F.lag), ("q", F.lead)) for c in near})

    # The lines that are drawn to the neighbours, as far as they are in the column.
    def at(a: str, z: str, ms: Column) -> Column:
        a, z = F.col(a), F.col(z)
        return a["v"] + (z["v"] - a["v"]) / (z["ms"] - a["ms"]) * (ms - a["ms"])

    t = t.withColumns(
        {
            "p_0": at("p_last", "first", F.greatest("c0", "p_last.ms")),
            "p_1": at("p_last", "first", F.least("c1", "first.ms")),
            "q_0": at("last", "q_first", F.greatest("c0", "last.ms")),
            "q_1": at("last", "q_first", F.least("c1", "q_first.ms")),
        }
    )
    t = t.withColumns({c: pixel(F.col(c)) for c in ("p_0", "p_1", "q_0", "q_1")})
    none = F.array().cast("array<struct<a:int,z:int>>")
    drawn = F.concat(*(F.when(F.col(f"{s}_joins"), F.array(_ordered(f"{s}_0", f"{s}_1"))).otherwise(none) for s in "pq"))

    def crossing(left: str, right: str) -> Column:
        """Ranges that the true line over a boundary may cover, from the columns beside it; null if no group tells."""
        a, z = lambda c: f"{left}{c}", lambda c: f"{right}{c}"
        across = F.array(_ordered(z("begins_mn"), a("ends_mx")), _ordered(z("begins_mx"), a("ends_mn")))
        return F.when(F.col(z("reached")), F.array(_ordered(z("begins_mn"), z("begins_mx")))).when(F.col(z("begun")) & F.col(a("ended")), across)

    # concat of a null is null: a boundary that no group tells about.
    true_lines = F.concat(F.when(F.col("p_joins"), crossing("p_", "")).otherwise(none), F.when(F.col("q_joins"), crossing("", "q_")).otherwise(none))
    inner = F.when(F.col("in_a").isNotNull(), F.sequence("in_a", "in_z")).otherwise(F.sequence(F.lit(1), F.lit(max(1, height - 1))))
    t = t.withColumns({"drawn": drawn, "true_lines": true_lines, "inner": inner})
    held = lambda c: F.filter(c, lambda r: r["a"].isNotNull() & r["z"].isNotNull())
    rows = lambda c: F.array_distinct(F.flatten(F.transform(held(c), lambda r: F.sequence(r["a"], r["z"]))))
    told = F.col("gapless") & F.col("true_lines").isNotNull()
    t = t.withColumns({"drawn": rows("drawn"), "true_lines": F.when(told, rows("true_lines"))})
    nothing, empty = F.col("exact") | (F.col("known") & (F.col("n") == 0)), F.array().cast("array<int>")
    false_ = F.when(told, F.array_except("drawn", "inner"))
    missing = F.when(told, F.array_except(F.array_except("true_lines", "inner"), "drawn"))
    t = t.withColumns({"false_": F.when(nothing, empty).otherwise(false_), "missing": F.when(nothing, empty).otherwise(missing)})
    error = F.when(F.col("false_").isNotNull() & F.col("missing").isNotNull(), (F.size("false_") + F.size("missing")) / F.lit(float(height)))
    return t.select("id", "px", "c0", "c1", "known", F.array_sort("missing").alias("missing"), F.array_sort("false_").alias("false_"), error.alias("error"))


def total_error(judged: DataFrame) -> DataFrame:
    """(id, columns, error): how many columns could be told, and the mean error of these; null without any."""
    return judged.groupBy("id").agg(F.count("error").alias("columns"), F.avg("error").alias("error"))


def intervals(judged: DataFrame, which: Column, gap: int = 10) -> DataFrame:
    """(id, low, high) of the columns that `which` chooses; those with at most `gap` others between are one interval."""
    by = Window.partitionBy("id").orderBy("px")
    t = judged.where(which).withColumn("new", F.coalesce(F.col("px") - F.lag("px").over(by) - 1 > gap, F.lit(True)).cast("int"))
    t = t.withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("id", "k").agg(F.min("c0").alias("low"), F.max("c1").alias("high")).select("id", "low", "high")


def high_error(judged: DataFrame, slack: float) -> DataFrame:
    """Intervals of columns that alone are worse than the slack."""
    return intervals(judged, F.col("error") > slack)


def inconclusive(judged: DataFrame) -> DataFrame:
    """Intervals of columns whose error can't be told."""
    return intervals(judged, F.col("error").isNull())


def unknown(table: DataFrame) -> DataFrame:
    """Intervals of columns that no group meets: what a cache has to fetch."""
    return intervals(table, ~F.col("known"))


def drawn(table: DataFrame) -> DataFrame:
    """(id, px, ts_ms, value): first, smallest, largest and last point of each column of columns(), each once."""
    points = [F.col("first"), F.col("last")]
    middle = F.floor((F.col("c0") + F.col("c1")) / 2).cast("long")
    points += [F.struct(middle.alias("ms"), F.col(c).alias("v")) for c in ("mn", "mx")]
    return table.where("n > 0").select("id", "px", F.inline(F.array_distinct(F.array(*points)))).select("id", "px", F.col("ms").alias("ts_ms"), F.col("v").alias("value"))


def similarity(a: DataFrame, b: DataFrame, width: int, height: int, block: int = 8) -> DataFrame:
    """(id, ssim): mean structural similarity of two rasters (id, px, py) over blocks of pixels; 1 for equal ones.

    A pixel is 1 where it is covered.  Blocks in which neither raster has a
    pixel are equal.  The constants are those of the published measure for a
    range of 1.
    """
    both = a.select("id", "px", "py", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("id", "px", "py", F.lit(0).alias("x"), F.lit(1).alias("y")))
    both = both.groupBy("id", "px", "py").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    tile = [F.floor(F.col(c) / block).alias(f"t{c}") for c in ("px", "py")]
    sums = both.groupBy("id", *tile).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    size = lambda c, end: F.least(F.lit(block), F.lit(end) - F.col(c) * block).cast("double")
    n = size("tpx", width) * size("tpy", height)
    mx, my = F.col("x") / n, F.col("y") / n
    vx, vy, cov = mx * (1 - mx), my * (1 - my), F.col("xy") / n - mx * my
    c1, c2 = 0.01**2, 0.03**2
    value = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    tiles = -(-width // block) * -(-height // block)
    return sums.groupBy("id").agg(((F.sum(value) + (tiles - F.count("*"))) / tiles).alias("ssim"))


def union(tables: list[DataFrame]) -> DataFrame:
    """Groups of several spans as one table."""
    return reduce(DataFrame.unionByName, tables)
