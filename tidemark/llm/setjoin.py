"""Pairs of similar sets, by the rarest elements and set sizes, checked exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace

#: Width of a band of set sizes, as a logarithm.
BAND = 0.01


def rare_pairs(open_: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes of different parts, from (cls, part, n), among which all are whose sets (cls, elements) are near enough.

    least: the least Jaccard index x / y.  Sets of n and m <= n elements that
    are near enough have x / (x + y) * (n + m) in common.  With all elements in
    order, the rarest first, the first common one is the i-th of the larger set
    and the j-th of the smaller one, and no more than 1 + min(n - i, m - j) are
    common.  So i is among the first n - x / y * n + 1, j among the first m -
    2 x / (x + y) * m + 1, and i limits m.  An edit of a text makes elements
    that nothing else has, which come first, so a text too far from the others
    of its group meets none of them: sets meet by (element, band of m), and
    only those of different parts.
    """
    x, y = least
    held = workspace.written(open_.join(sets, "cls"), "held")
    each = held.select("cls", F.explode("elements").alias("s"))
    total = held.agg(F.sum("n")).first()[0] or 0
    often = workspace.written(each.groupBy("s").agg(F.count("*").alias("often")).where("often > 1"), "often")
    common = workspace.lookup(each, often, ["s"], "often", total).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("common"))
    n = F.col("n")
    own = n - F.size("common")  # shingles that no other set has
    part_of = lambda top, down: (n - F.ceil(n * top / down) + 1).cast("int")
    ordered = common.join(open_, "cls").select("cls", "part", "n", own.cast("int").alias("own"), F.posexplode("common").alias("k", "e"))
    ordered = ordered.select("cls", "part", "n", (F.col("own") + F.col("k") + 1).alias("i"), "e.s").where(F.col("i") <= part_of(x, y))
    ordered = workspace.written(ordered, "rarest")
    band = lambda size: F.floor(F.log(size) / BAND).cast("int")
    index = ordered.where(F.col("i") <= part_of(2 * x, x + y)).select("s", band(n).alias("band"), F.col("cls").alias("b"), F.col("part").alias("other"), n.alias("m"), F.col("i").alias("j"))
    index = workspace.written(index, "index")
    low, high = F.ceil(n * x / y), F.least(n, F.floor((1 + n - F.col("i")) * (x + y) / x) - n)
    asked = ordered.where(low <= high).select("s", F.explode(F.sequence(band(low), band(high))).alias("band"), F.col("cls").alias("a"), "part", "n", "i")
    # Most of a group's sets are in one part: its members ask for the others only.
    met = index.groupBy("s", "band", "other").agg(F.count("*").alias("k")).groupBy("s", "band").agg(F.max(F.struct("k", "other")).alias("most"), F.sum("k").alias("met"))
    met = met.select("s", "band", F.col("most.other").alias("most"), (F.col("met") > F.col("most.k")).alias("mixed"), "met")
    met = workspace.written(met, "met")
    asked = workspace.written(asked.join(met, ["s", "band"]).where("mixed OR part <> most"), "asked")
    others = index.join(met.where("mixed"), ["s", "band"]).where("other <> most").select(index.columns)
    pairs = asked.where("part <> most").join(index, ["s", "band"]).unionByName(asked.where("part = most").join(others, ["s", "band"]))
    enough = (1 + F.least(n - F.col("i"), F.col("m") - F.col("j"))) * (x + y) >= (n + F.col("m")) * x
    near = (F.col("m") <= n) & (F.col("m") * y >= n * x) & (F.col("part") != F.col("other")) & enough
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(a, b, likeness) of the pairs (a, b) of classes, a written table, whose sets (cls, elements) are near enough: their Jaccard index."""
    total = pairs.count()
    one, other = (sets.select(F.col("cls").alias(x), F.col("elements").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    met = workspace.salted(workspace.salted(pairs, one, "a", F.hash("b"), total), other, "b", F.hash("a"), total)
    either = F.size("sa") + F.size("sb") - F.col("both")
    met = met.withColumn("both", both).where(F.col("both") * least[1] >= either * least[0])
    return met.select("a", "b", (F.col("both") / either).alias("likeness"))
