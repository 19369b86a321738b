"""Scores of found matches and summaries of query costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_scores(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """(id, tp, fp, fn): matches (id, b, to) paired one to one, from the left, where starts and ends differ by at most `tolerance`.

    Repeated matches count once.  Ids of either side appear; null ids pair with
    null ids.  One id's matches are walked in order by one task: they grow with
    the buckets, not with the rows of the series.
    """
    t = truth.select("id", "b", "to").distinct().withColumn("side", F.lit(0))
    f = found.select("id", "b", "to").distinct().withColumn("side", F.lit(1))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [sorted(map(tuple, pdf.loc[pdf["side"] == k, ["b", "to"]].to_numpy().tolist())) for k in (0, 1)]
        free, tp = sides[1], 0
        taken = [False] * len(free)
        first = 0
        for b, to in sides[0]:
            while first < len(free) and free[first][0] < b - tolerance:
                first += 1
            j = first
            while j < len(free) and free[j][0] <= b + tolerance:
                if not taken[j] and abs(free[j][1] - to) <= tolerance:
                    taken[j], tp = True, tp + 1
                    break
                j += 1
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "tp": [tp], "fp": [len(free) - tp], "fn": [len(sides[0]) - tp]})

    return t.unionByName(f).groupBy("id").applyInPandas(walk, "id string, tp bigint, fp bigint, fn bigint")


def precision_recall(scores: DataFrame) -> DataFrame:
    """scores with precision, recall and f1; null where nothing was found or nothing was there."""
    ratio = lambda down: F.when(down > 0, F.col("tp") / down)
    found, there = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return scores.withColumns({"precision": ratio(found), "recall": ratio(there), "f1": F.when(found + there > 0, 2 * F.col("tp") / (found + there))})


def confident_scores(truth: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """(id, tp, fp, fn, tp_confident, fp_confident): match_scores() of all of found (id, b, to, confident), and of the confident ones."""
    every = match_scores(truth, found, tolerance)
    sure = match_scores(truth, found.where("confident"), tolerance)
    sure = sure.select("id", F.col("tp").alias("tp_confident"), F.col("fp").alias("fp_confident"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(sure, every["id"].eqNullSafe(sure["id"]), "left").select(every["id"], "tp", "fp", "fn", zero("tp_confident"), zero("fp_confident"))


def accuracy_summary(scores: DataFrame) -> DataFrame:
    """(method, queries, macro_*, micro_*, pass_rate) of scores (method, query, tp, fp, fn, slack).

    macro: means of the queries' precision, recall and f1 (queries without one
    don't count); micro: of the summed counts; pass_rate: the share of queries
    with a precision of 1 - slack at least.
    """
    each = precision_recall(scores).groupBy("method")
    macro = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    passed = F.avg((F.col("precision") >= 1 - F.col("slack")).cast("int")).alias("pass_rate")
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    t = precision_recall(each.agg(F.count("*").alias("queries"), *macro, passed, *sums))
    micro = [F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")]
    return t.select("method", "queries", "macro_precision", "macro_recall", "macro_f1", *micro, "pass_rate")


def cost_summary(costs: DataFrame) -> DataFrame:
    """(method, runs, queries, total, mean, p95) of costs (method, run, seconds); each is the mean of the runs'.

    Where costs have fetched_bytes, hit_ratio and cache_bytes, also their total,
    mean and peak; negative ones mean that a method doesn't know them.
    """
    more = {c for c in ("fetched_bytes", "hit_ratio", "cache_bytes") if c in costs.columns}
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    each = [F.count("*").alias("queries"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.percentile("seconds", 0.95).alias("p95")]
    pick = {"fetched_bytes": F.sum, "hit_ratio": F.avg, "cache_bytes": F.max}
    runs = costs.groupBy("method", "run").agg(*each, *(pick[c](known(c)).alias(c) for c in sorted(more)))
    over = {"fetched_bytes": F.avg, "hit_ratio": F.avg, "cache_bytes": F.max}
    means = [F.avg(c).alias(c) for c in ("queries", "total", "mean", "p95")]
    return runs.groupBy("method").agg(F.count("*").alias("runs"), *means, *(over[c](c).alias(c) for c in sorted(more)))


def cohort_summary(scores: DataFrame) -> DataFrame:
    """(axis, cohort, queries, mean_precision, mean_recall, macro_f1, tp, fp, fn, micro_f1, mean_seconds) of scores with axis, cohort and seconds."""
    t = precision_recall(scores).groupBy("axis", "cohort")
    means = [F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("macro_f1")]
    t = t.agg(F.count("*").alias("queries"), *means, *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg("seconds").alias("mean_seconds"))
    either = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return t.withColumn("micro_f1", F.when(either > 0, 2 * F.col("tp") / either))


def view_summary(views: DataFrame) -> DataFrame:
    """(method, queries, mean and median of ssim and of different, the share of pixels that differ) of views (method, ssim, different)."""
    both = [f(c).alias(f"{name}_{c}") for c in ("ssim", "different") for name, f in (("mean", F.avg), ("median", F.median))]
    return views.groupBy("method").agg(F.count("*").alias("queries"), *both)


def scalability(costs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(dataset, rows, method, total): the time of a whole trace, the mean of its runs, beside the rows (dataset, rows) of its dataset."""
    runs = costs.groupBy("dataset", "method", "run").agg(F.sum("seconds").alias("s")).groupBy("dataset", "method").agg(F.avg("s").alias("total"))
    return runs.join(F.broadcast(sizes.select("dataset", "rows")), "dataset").select("dataset", "rows", "method", "total")  # a row for each dataset


def split_trace(lines: DataFrame) -> DataFrame:
    """(query, subset, place): of a trace's numbered lines (query, kind), the place of each among those of its kind, from 0."""
    by = Window.partitionBy("kind").orderBy("query")
    return lines.select("query", F.col("kind").alias("subset"), (F.row_number().over(by) - 1).cast("long").alias("place"))


def merged_trace(parts: DataFrame, split: DataFrame, method: str) -> DataFrame:
    """Costs of the parts of a trace (subset, place, run, seconds) with their number in the whole trace, as one method; lines not in the split go."""
    return parts.join(split, ["subset", "place"]).select(F.lit(method).alias("method"), "run", "query", "subset", "seconds")


def tightness(bounds: DataFrame) -> DataFrame:
    """(windows, mean_width, median_width, p95_width, undefined) of bounds (lo, hi, defined): widths of the defined, share of the others."""
    width = F.col("hi") - F.col("lo")
    widths = [F.avg(width).alias("mean_width"), F.percentile(width, 0.5).alias("median_width"), F.percentile(width, 0.95).alias("p95_width")]
    return bounds.agg(F.count("*").alias("windows"), *widths, F.avg((~F.col("defined")).cast("int")).alias("undefined"))


def risk_coverage(classified: DataFrame, steps: int = 10) -> DataFrame:
    """(threshold, covered, risk): share of matches with an overshoot of at most the threshold, and their mean overshoot; null without any."""
    limits = [k / steps for k in range(steps + 1)]
    o = F.col("overshoot")
    each = [F.struct(F.lit(x).alias("threshold"), F.count_if(o <= x).alias("k"), F.sum(F.when(o <= x, o)).alias("s")) for x in limits]
    t = classified.agg(F.count("*").alias("every"), F.array(*each).alias("each")).select("every", F.inline("each"))
    return t.select("threshold", F.when(F.col("every") > 0, F.col("k") / F.col("every")).alias("covered"), F.when(F.col("k") > 0, F.col("s") / F.col("k")).alias("risk"))
