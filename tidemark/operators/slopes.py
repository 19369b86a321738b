"""Regression slopes of runs of buckets, exact and bounded.

Runs are read off window frames over bounded blocks of time: each block of an
id's buckets also gets the first buckets of the next one, as many as a run may
reach into it, so a long series is the work of many tasks and positions stay
small numbers within a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a block, at least.
BLOCK = 4096


def angle(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Degrees of the least-squares slope; null without two different times."""
    down = n * sxx - sx * sx
    return F.when((n > 1) & (down != 0), F.degrees(F.atan((n * sxy - sx * sy) / down)))


def blocks(table: DataFrame, reach: int) -> tuple[DataFrame, int]:
    """(table with `block` and the place `at` of b in it, buckets of a block): the first `reach` buckets of a block also are in the one before."""
    size = max(BLOCK, 4 * reach)
    own = F.floor(F.col("b") / size).cast("long")
    both = F.array(own, F.when(F.col("b") - own * size < reach, own - 1))
    dealt = table.withColumn("block", F.explode(F.array_compact(both)))
    return dealt.withColumn("at", F.col("b") - F.col("block") * size), size


def runs(sums: DataFrame, low: int, high: int) -> DataFrame:
    """(id, b, len, angle) of every run of low..high buckets that all hold points, from regression_sums().

    Buckets follow each other by b; a column x0, where there is one, says at
    which bucket of time they are.
    """
    table, size = blocks(sums.where("n > 0"), high - 1)
    place = F.col("x0") - F.col("block") * size if "x0" in sums.columns else F.col("at")
    at, n = place.cast("double"), F.col("n").cast("double")
    # Positions count from the beginning of the block.
    moved = {"n": n, "sx": F.col("sx") + at * n, "sy": F.col("sy"), "sxy": F.col("sxy") + at * F.col("sy"), "sxx": F.col("sxx") + 2 * at * F.col("sx") + at * at * n}
    by = Window.partitionBy("id", "block").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    t = table.select("id", "block", "at", *(c.alias(f"own_{k}") for k, c in moved.items()))
    t = t.select("*", *(F.sum(f"own_{k}").over(upto).alias(k) for k in moved))
    t = t.withColumn("ahead", F.collect_list(F.struct("at", *moved)).over(by.rowsBetween(low - 1, high - 1)))
    t = t.where((F.col("at") >= 0) & (F.col("at") < size)).select("*", F.posexplode("ahead").alias("i", "end"))
    t = t.where(F.col("end.at") == F.col("at") + F.col("i") + (low - 1))  # no empty bucket lies between
    d = {k: F.col(f"end.{k}") - F.col(k) + F.col(f"own_{k}") for k in moved}
    out = t.select("id", (F.col("block") * size + F.col("at")).alias("b"), (F.col("i") + low).alias("len"), angle(d["n"], d["sx"], d["sy"], d["sxy"], d["sxx"]).alias("angle"))
    return out.where("angle IS NOT NULL")


def _sum(parts: Column, f) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + f(p))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def envelope(parts: Column) -> Column:
    """struct(est, lo, hi) of the slope of the points in `parts`, an array of (f, t, w, sm, mn, mx): w points between times f and t, in order.

    Null ends: the bounds don't hold the slope, or there are too few parts or points.
    """
    mid, half = lambda p: (p["f"] + p["t"]) / 2, lambda p: (p["t"] - p["f"]) / 2
    total = F.struct(
        _sum(parts, lambda p: p["w"]).alias("n"),
        _sum(parts, lambda p: p["w"] * mid(p)).alias("wm"),
        _sum(parts, lambda p: p["sm"]).alias("sm"),
        _sum(parts, lambda p: p["w"] * half(p)).alias("wh"),
    )

    def around(t: Column) -> Column:
        x, y, spread = t["wm"] / t["n"], t["sm"] / t["n"], t["wh"] / t["n"]
        dx, dy = lambda p: mid(p) - x, lambda p: p["sm"] / p["w"] - y
        off = lambda p: F.greatest(p["mx"] - p["sm"] / p["w"], p["sm"] / p["w"] - p["mn"])
        return F.struct(
            t["n"].alias("n"),
            _sum(parts, lambda p: p["w"] * dx(p) * dx(p)).alias("sxx"),
            _sum(parts, lambda p: p["w"] * dx(p) * dy(p)).alias("sxy"),
            _sum(parts, lambda p: p["w"] * half(p) * (F.abs(dy(p)) + 2 * off(p))).alias("exy"),
            _sum(parts, lambda p: p["w"] * F.abs(dx(p)) * 2 * half(p)).alias("less"),
            _sum(parts, lambda p: p["w"] * ((half(p) + spread) * (half(p) + spread) + half(p) * half(p))).alias("more"),
        )

    def ends(s: Column) -> Column:
        down = (s["sxx"] - s["less"], s["sxx"] + s["less"] + s["more"])
        each = [(s["sxy"] + e) / d for e in (s["exy"], -s["exy"]) for d in down]
        holds = (F.size(parts) > 1) & (s["n"] > 1) & (s["sxx"] > 0)
        bounded = holds & (down[0] > 0)
        return F.struct(
            F.when(holds, s["sxy"] / s["sxx"]).alias("est"),
            F.when(bounded, F.least(*each)).alias("lo"),
            F.when(bounded, F.greatest(*each)).alias("hi"),
        )

    return let(total, lambda t: let(around(t), ends))


def windows(sub: DataFrame, width: int, unit: int, length: int) -> DataFrame:
    """(id, b, parts) of every run of `length` units that all hold points, from aggregate() of sub-buckets `width` wide.

    parts: the sub-buckets that hold points and meet the run, in order, as
    envelope() takes them, times in units from the beginning of the run.  If
    `width` doesn't divide `unit`, the outer ones may reach over its ends.
    """
    f, t = F.col("b") * width, F.col("b") * width + width
    part = F.struct((f / unit).alias("f"), (t / unit).alias("t"), F.col("n").cast("double").alias("w"), "sm", "mn", "mx")
    units = F.sequence(F.floor(f / unit).cast("long"), F.floor((t - 1) / unit).cast("long"))
    table = sub.where("n > 0").select("id", F.explode(units).alias("u"), part.alias("part"))
    table = table.groupBy("id", F.col("u").alias("b")).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    table, size = blocks(table, length - 1)
    by = Window.partitionBy("id", "block").orderBy("at")
    ahead = F.collect_list(F.struct("at", "parts")).over(by.rowsBetween(0, length - 1))
    t = table.select("id", "block", "at", "b", ahead.alias("ahead")).where((F.col("at") >= 0) & (F.col("at") < size))
    t = t.where((F.size("ahead") == length) & (F.col("ahead")[length - 1]["at"] == F.col("at") + (length - 1)))
    every = F.array_distinct(F.flatten(F.transform("ahead", lambda x: x["parts"])))  # one that reaches into two units comes twice
    here = F.transform(every, lambda p: F.struct((p["f"] - F.col("b")).alias("f"), (p["t"] - F.col("b")).alias("t"), p["w"].alias("w"), p["sm"].alias("sm"), p["mn"].alias("mn"), p["mx"].alias("mx")))
    return t.select("id", "b", here.alias("parts"))


def _degrees(t: DataFrame, bounds: Column) -> DataFrame:
    deg = lambda c: F.degrees(F.atan(F.col(f"x.{c}"))).alias(c)
    t = t.select("id", "b", bounds.alias("x")).select("id", "b", deg("est"), deg("lo"), deg("hi"))
    return t.withColumn("defined", F.col("lo").isNotNull() & F.col("hi").isNotNull())


def interval(sub: DataFrame, factor: int, length: int) -> DataFrame:
    """(id, b, est, lo, hi, defined): bounds of the slope angle of `length` buckets from aggregate() of sub-buckets, `factor` to a bucket.

    Only min, max, count and sum of the sub-buckets are used; the exact slope
    lies between the bounds.  Empty sub-buckets are passed over; a run needs
    points in each of its buckets.  Where the bounds are undefined (fewer than
    two sub-buckets, or times that could coincide) the row says so.
    """
    return _degrees(windows(sub, 1, factor, length), envelope(F.col("parts")))


def straddling_interval(sub: DataFrame, width: int, unit: int, length: int) -> DataFrame:
    """interval() of sub-buckets whose width doesn't divide the unit: the hull of the bounds with and without those that reach over an end.

    est is that of all parts, or the middle of the hull where it is undefined.
    """
    parts = F.col("parts")
    last = F.element_at(parts, -1)
    left, right = (parts[0]["f"] < 0).cast("int"), (last["t"] > length).cast("int")
    cuts = [F.slice(parts, F.lit(1) + a * left, F.greatest(F.size(parts) - a * left - z * right, F.lit(0))) for a in (0, 1) for z in (0, 1)]
    each = F.transform(F.array(*cuts), lambda p: envelope(p))

    def hull(e: Column) -> Column:
        lo, hi = F.array_min(F.transform(e, lambda x: x["lo"])), F.array_max(F.transform(e, lambda x: x["hi"]))
        return F.struct(F.coalesce(F.when(e[0]["lo"].isNotNull(), e[0]["est"]), (lo + hi) / 2).alias("est"), lo.alias("lo"), hi.alias("hi"))

    return _degrees(windows(sub, width, unit, length), let(each, hull))


def rigorous_interval(sub: DataFrame, width: int, unit: int, length: int) -> DataFrame:
    """straddling_interval() that holds the slope whatever part of the outer sub-buckets lies inside.

    For each number of points that an outer sub-bucket may have inside, its
    inner sum is between limits that its minimum, maximum and total set; the
    bounds are the hull over all numbers, found without trying each.  NumPy, a
    window at a time.
    """

    @F.pandas_udf("struct<est double, lo double, hi double>")
    def bound(parts: pd.Series) -> pd.DataFrame:
        each = [rigorous_bounds(np.array([[p[k] for k in ("f", "t", "w", "sm", "mn", "mx")] for p in x]), float(length)) for x in parts]
        return pd.DataFrame(each, columns=["est", "lo", "hi"])

    return _degrees(windows(sub, width, unit, length), bound("parts"))


#: Pairs of numbers of inner points that are looked at one by one: in all, and in a box of them.
PAIRS, CELL = 1 << 12, 8


def rigorous_bounds(parts: np.ndarray, end: float) -> tuple[float | None, float | None, float | None]:
    """(est, lo, hi) for rows (f, t, w, sm, mn, mx) over the time from 0 to `end`.

    The hull over all pairs of numbers of inner points at both ends, by branch
    and bound: boxes of pairs that can't reach beyond the hull so far are left
    out, others are cut into four, small ones taken pair by pair.
    """
    cut = _Cut(parts, end)
    some = 0 if len(cut.w) else 1  # without known parts both ends need a point
    if some and min(cut.k) < 1:
        return None, None, None
    sides = []
    for side in (0, 1):
        ends = sorted({some, cut.k[side], *(int(x) + i for x in cut.kinks(side) if some <= x < cut.k[side] for i in (0, 1))})
        ends = [x for x in ends if some <= x <= cut.k[side]]
        sides.append([(x, y) for x, y in zip(ends[:-1], ends[1:], strict=True)] or [(some, some)])
    box = np.array([(*x, *y) for x in sides[0] for y in sides[1]], np.int64).T
    lo, hi = np.inf, -np.inf
    if (cut.k[0] + 1) * (cut.k[1] + 1) <= PAIRS:
        box = np.array([(some, cut.k[0], some, cut.k[1])], np.int64).T
    while box.shape[1]:
        a0, a1, z0, z1 = box
        whole = ((a1 - a0 < CELL) & (z1 - z0 < CELL)) | ((cut.k[0] + 1) * (cut.k[1] + 1) <= PAIRS)
        pairs = [np.concatenate((a0, a0, a1, a1)), np.concatenate((z0, z1, z0, z1))]
        if whole.any():
            x, y = (u[whole, None] + np.arange((v - u)[whole].max() + 1) for u, v in ((a0, a1), (z0, z1)))
            x, y = np.minimum(x, a1[whole, None]), np.minimum(y, z1[whole, None])
            shape = (len(x), x.shape[1], y.shape[1])
            pairs = [np.concatenate((p, np.broadcast_to(q, shape).ravel())) for p, q in zip(pairs, (x[:, :, None], y[:, None, :]), strict=True)]
        low, high, down, _ = cut.at(*pairs)
        if not np.all(down > 0):
            return None, None, None
        lo, hi = min(lo, low.min()), max(hi, high.max())
        box = box[:, ~whole]
        low, high = cut.reach(*box)
        a0, a1, z0, z1 = box[:, (low < lo) | (high > hi)]
        am, zm = (a0 + a1) // 2, (z0 + z1) // 2
        box = np.concatenate([np.stack(b) for b in ((a0, am, z0, zm), (am + 1, a1, z0, zm), (a0, am, zm + 1, z1), (am + 1, a1, zm + 1, z1))], axis=1)
        box = box[:, (box[0] <= box[1]) & (box[2] <= box[3])]
    if not lo <= hi:
        return None, None, None
    return float(cut.at(*(np.array([k]) for k in cut.k))[3][0]), float(lo), float(hi)


class _Cut:
    """Bounds of the slope of parts of which the outer two may be cut, by the numbers a and z of their points inside.

    The sums over known parts are polynomials, or piecewise linear, in the means
    of time and value, so a pair of numbers takes the same work however many parts there are.
    """

    def __init__(self, parts: np.ndarray, end: float):
        left, right = parts[0, 0] < 0, len(parts) > 1 and parts[-1, 1] > end or len(parts) == 1 and parts[0, 0] >= 0 and parts[0, 1] > end
        inner = parts[int(left) : len(parts) - int(right)]
        # Slopes don't depend on the origin; a near one keeps digits.
        x, y = end / 2, parts[:, 3].sum() / parts[:, 2].sum()
        f, t, w, sm, mn, mx = inner.T
        self.w, m, h, v = w, (f + t) / 2 - x, (t - f) / 2, sm / w - y
        self.n, self.m1, self.m2, self.v1, self.mv = w.sum(), w @ m, w @ (m * m), w @ v, w @ (m * v)
        self.h1, self.h2 = w @ h, w @ (h * h)
        self.inside = w @ (h * np.maximum(mx - y - v, v - (mn - y)))
        self.far_x, self.far_y = _distances(m, w * h), _distances(v, w * h)
        # Of each end: number of points, middle and half width of what is inside, sum, minimum and maximum.
        none = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        outer = []
        for p, there in ((parts[0], left), (parts[-1], right)):
            f, t = max(p[0], 0.0), min(p[1], end)
            outer.append((int(p[2]), (f + t) / 2 - x, (t - f) / 2, p[3] - p[2] * y, p[4] - y, p[5] - y) if there else none)
        self.k, self.mid, self.half, self.sm, self.mn, self.mx = zip(*outer, strict=True)

    def kinks(self, side: int) -> list[float]:
        """Numbers of points at which the limits of the inner sum bend."""
        wide = self.mx[side] - self.mn[side]
        if not wide > 0:
            return []
        up = (self.sm[side] - self.k[side] * self.mn[side]) / wide
        return [up, self.k[side] - up]

    def limits(self, side: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest sum of c points inside."""
        sm, mn, mx, out = self.sm[side], self.mn[side], self.mx[side], self.k[side] - c
        low, high = np.maximum(c * mn, sm - out * mx), np.minimum(c * mx, sm - out * mn)
        return np.where(c > 0, low, 0.0), np.where(c > 0, high, 0.0)

    def means(self, a: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        """Number of points, mean time, mean half width, least and largest mean value."""
        n = self.n + a + z
        per = 1 / np.maximum(n, 1)
        (l0, l1), (r0, r1) = self.limits(0, a), self.limits(1, z)
        return [n, (self.m1 + a * self.mid[0] + z * self.mid[1]) * per, (self.h1 + a * self.half[0] + z * self.half[1]) * per, (self.v1 + l0 + r0) * per, (self.v1 + l1 + r1) * per]

    def at(self, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, down, est) of pairs; those without two parts and two points are infinite."""
        n, x, spread, y0, y1 = self.means(a, z)
        sxx, less = self.m2 - x * (2 * self.m1 - x * self.n), self.far_x(x)
        e = self.far_y((y0 + y1) / 2) + self.h1 * np.abs(y1 - y0) / 2 + 2 * self.inside
        sxy0 = sxy1 = self.mv - x * self.v1
        hh = self.h2
        for side, c in ((0, a), (1, z)):
            d, half, (low, high) = self.mid[side] - x, self.half[side], self.limits(side, c)
            sxx, less, hh = sxx + c * d * d, less + c * half * np.abs(d), hh + c * half * half
            e = e + half * (np.maximum(np.abs(high - c * y0), np.abs(low - c * y1)) + 2 * np.maximum(c * self.mx[side] - low, high - c * self.mn[side]))
            sxy0, sxy1 = sxy0 + np.minimum(d * low, d * high), sxy1 + np.maximum(d * low, d * high)
        ok = (len(self.w) + (a > 0) + (z > 0) >= 2) & (n >= 2)
        down, up = sxx - 2 * less, sxx + 2 * less + 2 * hh + 3 * spread * spread * n
        down = np.where(ok, np.where(down > 1e-12 * (sxx + 2 * less), down, 0.0), np.inf)  # what rounding leaves isn't above 0
        with np.errstate(all="ignore"):
            low, high = np.minimum((sxy0 - e) / down, (sxy0 - e) / up), np.maximum((sxy1 + e) / down, (sxy1 + e) / up)
            return np.where(ok, low, np.inf), np.where(ok, high, -np.inf), down, (sxy0 + sxy1) / 2 / sxx

    def reach(self, a0: np.ndarray, a1: np.ndarray, z0: np.ndarray, z1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values that low and high of no pair of a box pass; infinite where it may have an undefined one. Limits don't bend inside a box."""
        corners = zip(*(self.means(a, z) for a in (a0, a1) for z in (z0, z1)), strict=True)
        (_, n1), (x0, x1), (_, spread), (u0, u1), (v0, v1) = ((np.minimum.reduce(c), np.maximum.reduce(c)) for c in map(list, corners))
        sxx = lambda x: self.m2 - x * (2 * self.m1 - x * self.n)
        least, most = sxx(np.clip(self.m1 / max(self.n, 1), x0, x1)), np.maximum(sxx(x0), sxx(x1))
        less, hh = np.maximum(self.far_x(x0), self.far_x(x1)), self.h2
        e = np.maximum(self.far_y((u0 + v0) / 2), self.far_y((u1 + v1) / 2)) + self.h1 * np.maximum(v1 - u0, u1 - v0) / 2 + 2 * self.inside
        sxy0, sxy1 = (g(self.mv - x0 * self.v1, self.mv - x1 * self.v1) for g in (np.minimum, np.maximum))
        for side, c0, c1 in ((0, a0, a1), (1, z0, z1)):
            d0, d1, half = self.mid[side] - x1, self.mid[side] - x0, self.half[side]
            far, near = np.maximum(np.abs(d0), np.abs(d1)), np.where((d0 < 0) & (d1 > 0), 0.0, np.minimum(np.abs(d0), np.abs(d1)))
            least, most, less, hh = least + c0 * near * near, most + c1 * far * far, less + c1 * half * far, hh + c1 * half * half
            (l0, h0), (l1, h1) = self.limits(side, c0), self.limits(side, c1)
            low, high = np.minimum(l0, l1), np.maximum(h0, h1)
            times = [d * s for d in (d0, d1) for s in (low, high)]
            sxy0, sxy1 = sxy0 + np.minimum.reduce(times), sxy1 + np.maximum.reduce(times)
            u, v = ([c * y for c in (c0, c1) for y in ys] for ys in ((u0, u1), (v0, v1)))
            away = [high - np.minimum.reduce(u), np.maximum.reduce(u) - np.minimum(h0, h1), np.maximum.reduce(v) - low, np.maximum(l0, l1) - np.minimum.reduce(v)]
            inside = [g for c, l, h in ((c0, l0, h0), (c1, l1, h1)) for g in (c * self.mx[side] - l, h - c * self.mn[side])]
            e = e + half * (np.maximum.reduce(away) + 2 * np.maximum.reduce(inside))
        down, up = least - 2 * less, most + 2 * less + 2 * hh + 3 * spread * spread * n1
        with np.errstate(all="ignore"):
            low = np.where(sxy0 - e < 0, (sxy0 - e) / down, (sxy0 - e) / up)
            high = np.where(sxy1 + e > 0, (sxy1 + e) / down, (sxy1 + e) / up)
        return np.where(down > 0, low, -np.inf), np.where(down > 0, high, np.inf)


def _distances(at: np.ndarray, weights: np.ndarray):
    """x -> the sum of weights times distances of x to `at`."""
    order = np.argsort(at)
    at, weights = at[order], weights[order]
    w, wx = (np.concatenate(([0.0], np.cumsum(v))) for v in (weights, weights * at))

    def total(x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(at, x)
        return np.maximum(x * (2 * w[i] - w[-1]) - (2 * wx[i] - wx[-1]), 0.0)

    return total


def unit_error(bounds: DataFrame) -> DataFrame:
    """(id, windows, error): the mean share of all angles that bounds leave open, 1 where they are undefined."""
    share = F.coalesce((F.col("hi") - F.col("lo")) / 180, F.lit(1.0))
    return bounds.groupBy("id").agg(F.count("*").alias("windows"), F.avg(share).alias("error"))


def vertex_bounds(points: DataFrame, *by: str) -> DataFrame:
    """(by, lo, hi): range of the slope of points (x, y_min, y_max), whose y lies between; without two different x there is none."""
    means = points.groupBy(*by).agg(F.avg("x").alias("xm"), F.count("*").alias("points"))
    xc = F.col("x") - F.col("xm")
    mid = (F.col("y_min") + F.col("y_max")) / 2
    high = F.when(xc > 0, F.col("y_max")).when(xc < 0, F.col("y_min")).otherwise(mid)
    low = F.when(xc > 0, F.col("y_min")).when(xc < 0, F.col("y_max")).otherwise(mid)
    sums = points.join(means, list(by)).groupBy(*by)
    got = sums.agg(F.max("points").alias("points"), F.sum(xc * xc).alias("d"), F.sum(xc * low).alias("l"), F.sum(xc * high).alias("h"))
    return got.where("points > 1 AND d > 0").select(*by, (F.col("l") / F.col("d")).alias("lo"), (F.col("h") / F.col("d")).alias("hi"))


def sampled_ci(sums: DataFrame) -> DataFrame:
    """(id, b, n, est, lo, hi): slope angle of regression_sums() of a sample, with 1.96 standard errors around it."""
    n = F.col("n")
    sxx, sxy, syy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("syy") - F.col("sy") ** 2 / n
    slope = sums.where("n > 1").select("id", "b", "n", sxx.alias("xx"), sxy.alias("xy"), syy.alias("yy")).where("xx > 0").withColumn("s", F.col("xy") / F.col("xx"))
    error = F.when(n > 2, F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - F.col("s") * F.col("xy")) / (n - 2) / F.col("xx"))).otherwise(0.0)
    deg = lambda c: F.degrees(F.atan(c))
    return slope.select("id", "b", "n", deg(F.col("s")).alias("est"), deg(F.col("s") - 1.96 * error).alias("lo"), deg(F.col("s") + 1.96 * error).alias("hi"))


def bootstrap_ci(sample: DataFrame, width: int, origin: int, draws: int = 500, level: float = 0.95) -> DataFrame:
    """(id, b, n, est, lo, hi): slope angle of rank_sample() in each bucket, with percentile bounds over `draws` resamples.

    A sample is bounded by its ranks, so it is gathered by bucket.  The draws
    depend on the bucket's number only; a bucket without two times is unbounded
    (-90 to 90) and without an estimate.
    """

    @F.pandas_udf("struct<est double, lo double, hi double>")
    def bound(b: pd.Series, points: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_bootstrap(int(k), np.array([[p["x"], p["y"]] for p in x]), draws, level) for k, x in zip(b, points, strict=True)], columns=["est", "lo", "hi"])

    x = (F.col("ts_ms") - origin) / F.lit(float(width)) - F.col("b")
    points = F.array_sort(F.collect_list(F.struct(x.alias("x"), F.col("value").alias("y"))))
    t = sample.groupBy("id", "b").agg(F.count("*").alias("n"), points.alias("points"))
    return t.withColumn("x", bound("b", "points")).select("id", "b", "n", "x.est", "x.lo", "x.hi")


def _bootstrap(seed: int, xy: np.ndarray, draws: int, level: float) -> tuple[float | None, float, float]:
    def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dx = x - x.mean(axis=-1, keepdims=True)
        with np.errstate(all="ignore"):
            return np.degrees(np.arctan((dx * y).sum(axis=-1) / (dx * dx).sum(axis=-1)))

    x, y = xy.T
    if len(np.unique(x)) < 2:
        return None, -90.0, 90.0
    take = np.random.default_rng(seed & 0x7FFFFFFF).integers(0, len(x), (draws, len(x)))
    found = slopes(x[take], y[take])
    found = found[np.isfinite(found)]
    tail = 100 * (1 - level) / 2
    low, high = np.percentile(found, [tail, 100 - tail]) if len(found) else (-90.0, 90.0)
    est = float(slopes(x, y))
    return est, min(float(low), est), max(float(high), est)


def overshoot(lo: Column, hi: Column, low: float, high: float) -> Column:
    """Share of [lo, hi] outside [low, high]; 0 if it has no width."""
    out = (F.greatest(F.lit(0.0), F.lit(low) - lo) + F.greatest(F.lit(0.0), hi - F.lit(high))) / (hi - lo)
    return F.when(hi > lo, F.least(F.lit(1.0), out)).otherwise(0.0)
