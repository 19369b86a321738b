"""Answers views and pattern queries to a wanted accuracy, from kept aggregates first.

The driver only decides over constants (widths, intervals, one error for each
measure); every step is a DataFrame plan.  Aggregates lie on a grid from the
epoch.  A view's first groups are a ladder width narrower than a pixel column;
each refinement halves the width where columns are in doubt, and what is still
in doubt at the end is read exactly.  Patterns do the same with the sub-buckets
of their time unit.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import workspace
from tidemark.functions.timeunits import align, group_intervals, next_factor, snap_down
from tidemark.operators import buckets, patterns, pixels, visual
from tidemark.plans.coverage import Cache, Span, coverage, prefetch, raw, view_coverage
from tidemark.sources.series import within


@dataclass(frozen=True)
class View:
    """Points of measures over [low, high) for width x height pixels; widths: aggregates of a given width for some measures instead."""

    low: int
    high: int
    measures: tuple[str, ...]
    width: int = 800
    height: int = 400
    accuracy: float = 0.95
    widths: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        _check(self)
        if not self.measures or self.width < 1 or self.height < 2 or self.high - self.low < self.width:
            raise ValueError(f"no view: {self}")

    @property
    def column(self) -> int:
        return (self.high - self.low) // self.width


@dataclass(frozen=True)
class PatternQuery:
    """Matches of a pattern over [low, high) of a measure, in buckets of `unit`."""

    low: int
    high: int
    measure: str
    unit: int
    parts: tuple[patterns.Segment | patterns.Group, ...]
    accuracy: float = 0.95

    def __post_init__(self) -> None:
        _check(self)
        if not self.parts or self.unit < 1:
            raise ValueError(f"no pattern query: {self}")


def _check(q: View | PatternQuery) -> None:
    if not 0 <= q.accuracy <= 1 or q.low >= q.high:
        raise ValueError(f"accuracy must be in 0..1 and the range not empty: {q}")


@dataclass
class Metrics:
    """What a query took; bytes are those of kept buckets."""

    query_type: str
    low: int
    high: int
    accuracy: float
    seconds: float = 0.0
    fetched_bytes: int = 0
    hit_ratio: float = 0.0
    cache_bytes: int = 0
    initial_factor: int = 0
    final_factor: int = 0
    refined: bool = False
    fallback: bool = False
    error_before: float = 0.0
    error_after: float = 0.0
    ambiguous_after: int = 0


@dataclass
class Result:
    rows: DataFrame
    metrics: Metrics
    errors: dict[str, float] = field(default_factory=dict)


@dataclass
class Engine:
    """Answers queries over a series (id, ts_ms, value).

    sampling: the usual time between points.  reduction: points that a group
    has to stand for at least, else points are read.  scoped: refine only what
    is in doubt; else all of the range, in one step.  ahead: share of a view's
    length to fetch around it (half on each side).
    """

    series: DataFrame
    sampling: int
    first: int
    last: int
    initial_factor: int = 4
    reduction: int = 2
    steps: int = 20
    scoped: bool = True
    ahead: float = 0.0
    budget: int = 1000 << 20

    def __post_init__(self) -> None:
        self.cache = Cache(self.series, 0, self.budget)

    def execute(self, query: View | PatternQuery) -> Result:
        """Evicts what is too much, then answers by the kind of query."""
        self.cache.evict()
        began, fetched = time.time(), self.cache.fetched
        hits = self.cache.hit_ms, self.cache.miss_ms
        result = self._view(query) if isinstance(query, View) else self._pattern(query)
        m = result.metrics
        m.seconds, m.fetched_bytes, m.cache_bytes = time.time() - began, self.cache.fetched - fetched, self.cache.bytes
        hit, miss = self.cache.hit_ms - hits[0], self.cache.miss_ms - hits[1]
        m.hit_ratio = hit / (hit + miss) if hit + miss else 0.0
        return result

    def close(self) -> None:
        self.cache.close()

    def cap(self, width: int) -> int:
        """The largest factor at which a group still stands for `reduction` points."""
        return max(1, width // (max(1, self.reduction) * max(1, self.sampling)))

    # Views

    def _view(self, q: View) -> Result:
        if q.widths:
            return Result(self.by_widths(q), Metrics("view", q.low, q.high, q.accuracy))
        low, high = max(q.low, self.first), min(q.high, self.last)
        if high - low >= q.width:  # else there is less to draw than columns
            q = replace(q, low=low, high=high)
        m = Metrics("view", q.low, q.high, q.accuracy, initial_factor=self.initial_factor, final_factor=self.initial_factor)
        if q.accuracy == 1:
            return Result(self.exact_view(q), m, dict.fromkeys(q.measures, 0.0))
        slack, cap = 1 - q.accuracy, self.cap(q.column)
        factor = {x: min(cap, self.initial_factor) for x in q.measures}
        base = snap_down(max(1, q.column // max(2, min(cap, self.initial_factor))))
        grid = align(q.low, q.high, base)
        # Parts of the range and what answers them, by measure; a part with no span is read point by point.
        parts: dict[str, list[tuple[Span | None, int, int]]] = {}
        wanted: dict[str, list[tuple[int, int]]] = {}
        for x in q.measures:
            self.cache.recent.append((x, q.low, q.high, base))
            owned, missing = view_coverage(self.cache.tables, x, q.low, q.high, q.column)
            self.cache.hit_ms += sum(min(z, q.high) - max(a, q.low) for _, a, z in owned)
            self.cache.miss_ms += sum(z - a for a, z in missing)
            parts[x] = list(owned)
            wanted[x] = [align(a, z, base) for a, z in missing]
        self._fill(parts, wanted, base)
        judged, errors = self._judge(q, parts)
        m.error_before = max(errors.values(), default=0.0)
        for step in range(self.steps if self.scoped else 1):
            doubtful = {x: e for x, e in errors.items() if e > slack}
            ahead = {x: next_factor(factor[x], e, slack, cap) for x, e in doubtful.items()}
            ahead = {x: f for x, f in ahead.items() if f and f != factor[x] and base % (1 << (step + 1)) == 0}
            if not ahead:
                break
            m.refined = True
            factor |= ahead
            m.final_factor = max(factor.values())
            narrow = base >> (step + 1)
            at = self._intervals(judged, slack, list(ahead)) if self.scoped else {x: [grid] for x in ahead}
            self._refine(parts, at, base, narrow)
            judged, errors = self._judge(q, parts)
        exact: dict[str, list[tuple[int, int]]] = {}
        doubtful = [x for x, e in errors.items() if e > slack]
        if doubtful:
            m.fallback = True
            exact = self._intervals(judged, slack, doubtful) if self.scoped else {x: [(q.low, q.low + q.column * q.width)] for x in doubtful}
        m.error_after = max((e for x, e in errors.items() if x not in exact), default=0.0)
        for a, z in prefetch(q.low, q.high, self.ahead, self.first, self.last):
            low, high = align(a, z, base)
            free = {x: coverage(self.cache.tables, x, low, high, base)[1] for x in q.measures}
            self.cache.fetch(free, base)
        return Result(self._drawn(q, parts, exact), m, {x: 0.0 if x in exact else e for x, e in errors.items()})

    def _fill(self, parts: dict[str, list], wanted: dict[str, list[tuple[int, int]]], width: int) -> None:
        """Fetches intervals at a width and adds them to the parts; as points where groups would stand for too few."""
        wanted = {x: group_intervals(v, 0) for x, v in wanted.items() if v}
        if width >= self.reduction * self.sampling:
            self.cache.fetch(wanted, width)
        for x, v in wanted.items():
            for a, z in v:
                span = Span(x, width, a, z, self.cache.each)
                parts[x].append((span if span in self.cache.tables else None, a, z))

    def _refine(self, parts: dict[str, list], at: dict[str, list[tuple[int, int]]], base: int, narrow: int) -> None:
        """Gives intervals, widened to the grid of `base`, to groups of `narrow`; the other parts keep the rest."""
        wanted = {}
        for x, intervals in at.items():
            cut = group_intervals([align(a, z, max([base, *(s.width for s, _, _ in parts[x] if s)])) for a, z in intervals], 0)
            rest = []
            for s, a, z in parts[x]:
                free = [(a, z)]
                for low, high in cut:
                    free = [p for y, w in free for p in ((y, min(w, low)), (max(y, high), w)) if p[0] < p[1]]
                rest += [(s, *p) for p in free]
            parts[x] = rest
            owned, missing = coverage([s for s in self.cache.tables if s.width == narrow], x, cut[0][0], cut[-1][1], narrow) if cut else ([], [])
            inside = lambda pairs: [(max(a, low), min(z, high)) for a, z in pairs for low, high in cut if max(a, low) < min(z, high)]
            for s, a, z in owned:
                parts[x] += [(s, *p) for p in inside([(a, z)])]
            wanted[x] = inside(missing)
        self._fill(parts, wanted, narrow)

    def _groups(self, q: View, parts: dict[str, list]) -> DataFrame:
        tables = []
        for x, pieces in parts.items():
            for s, a, z in pieces:
                if s is None:
                    points = within(self.series, max(a, q.low), min(z, q.high)).where(F.col("id") == x)
                    tables.append(pixels.groups_of_raw(points).withColumn("raw", F.lit(True)))
                else:
                    dense = pixels.filled(self.cache.part(s, a, z), x, a // s.width, (z - a) // s.width)
                    tables.append(pixels.groups_of_extents(dense, s.width, 0).withColumn("raw", F.lit(False)))
        return pixels.union(tables)

    def _judge(self, q: View, parts: dict[str, list]) -> tuple[DataFrame, dict[str, float]]:
        """(errors by column, mean error by measure). Columns of points alone are exact."""
        groups = self._groups(q, parts)
        read = pixels.routed(groups.where("raw"), q.low, q.high, q.width).select("id", "px").distinct().withColumn("read", F.lit(True))
        table = pixels.columns(groups.drop("raw"), q.low, q.high, q.width).join(read, ["id", "px"], "left")
        judged = workspace.written(pixels.errors(table, q.height, F.coalesce("read", F.lit(False))), "columns")
        found = {r["id"]: r["error"] for r in pixels.total_error(judged).collect()}  # one number for each measure
        return judged, {x: found.get(x) or 0.0 for x in q.measures}

    def _intervals(self, judged: DataFrame, slack: float, measures: Sequence[str]) -> dict[str, list[tuple[int, int]]]:
        """High-error and untold intervals of measures: at most a view's columns each."""
        doubt = (F.col("error") > slack) | (F.col("error").isNull() & F.col("known"))
        out: dict[str, list[tuple[int, int]]] = {x: [] for x in measures}
        for r in pixels.intervals(judged.where(F.col("id").isin(list(measures))), doubt).collect():
            out[r["id"]].append((r["low"], r["high"]))
        return out

    def _drawn(self, q: View, parts: dict[str, list], exact: dict[str, list[tuple[int, int]]]) -> DataFrame:
        """(id, px, ts_ms, value): four points of each column; exact ones where intervals are given."""
        rows = pixels.drawn(pixels.columns(self._groups(q, parts).drop("raw"), q.low, q.high, q.width))
        px = lambda ms: (ms - q.low) // q.column
        for x, intervals in exact.items():
            for a, z in intervals:
                rows = rows.where(~((F.col("id") == x) & (F.col("px") >= px(a)) & (F.col("px") < px(z))))
        holds = [(F.col("id") == x) & (F.col("ts_ms") >= a) & (F.col("ts_ms") < z) for x, v in exact.items() for a, z in v]
        if holds:
            chosen = holds[0]
            for h in holds[1:]:
                chosen = chosen | h
            table = visual.columns(within(self.series, q.low, q.high).where(chosen), q.low, q.high, q.width)
            rows = rows.unionByName(visual.points(table).select("id", F.col("b").cast("int").alias("px"), "ts_ms", "value"))
        return rows.orderBy("id", "ts_ms")

    def exact_view(self, q: View) -> DataFrame:
        """The four points of every column, read from the series."""
        table = visual.columns(self.series.where(F.col("id").isin(list(q.measures))), q.low, q.high, q.width)
        return visual.points(table).select("id", F.col("b").cast("int").alias("px"), "ts_ms", "value").orderBy("id", "ts_ms")

    def by_widths(self, q: View) -> DataFrame:
        """(id, b, mn, mx, n, sm) of each measure at its own width, over the part of its grid that holds the range."""
        out = None
        for x, width in q.widths:
            t = self.cache.aggregate(x, *align(q.low, q.high, width), width)
            out = t if out is None else out.unionByName(t)
        return out

    # Patterns

    def _pattern(self, q: PatternQuery) -> Result:
        low, high = align(max(q.low, self.first), min(q.high, self.last), q.unit)
        slack, cap = 1 - q.accuracy, self.cap(q.unit)
        factor = self._fitting(q.unit, min(cap, self.initial_factor))
        m = Metrics("pattern", q.low, q.high, q.accuracy, initial_factor=factor, final_factor=factor)
        plain = all(isinstance(s, patterns.Segment) and s.at_least == s.at_most == 1 for s in q.parts)
        if q.accuracy == 1 or not plain:
            return Result(self.exact_pattern(q), m)
        pad = 2 * q.unit
        sure, doubt = self._classified(q, [(low, high)], factor, slack)
        counts = self._counts(sure, doubt)
        m.error_before = m.error_after = counts[0]
        step = 0
        while m.error_after > slack and counts[2] and step < self.steps and (self.scoped or step == 0):
            following = next_factor(factor, m.error_after, slack, cap)
            following = self._fitting(q.unit, following) if following else None
            if not following or following <= factor:
                break
            factor, step, m.refined = following, step + 1, True
            found, doubt = self._classified(q, self._regions(doubt, q, low, high, pad), factor, slack)
            sure = workspace.written(sure.unionByName(found).dropDuplicates(["id", "b", "to", "lens"]), "sure")
            counts = self._counts(sure, doubt)
            m.error_after = counts[0]
        m.final_factor = factor
        if m.error_after > slack:
            m.fallback = True
            kept = self.exact_pattern(q, self._regions(doubt, q, low, high, pad)).select("id", "b", "to", "lens")
            sure = sure.unionByName(kept.select("*", F.lit(0.0).alias("overshoot"), F.lit(True).alias("confident")))
            m.error_after, doubt = 0.0, None
        rows = sure if doubt is None else sure.unionByName(doubt)
        m.ambiguous_after = 0 if doubt is None else counts[2]
        return Result(rows.dropDuplicates(["id", "b", "to", "lens"]).orderBy("id", "b"), m)

    def _fitting(self, unit: int, factor: int) -> int:
        """The largest number of sub-buckets up to `factor` that cut a unit evenly."""
        return next(f for f in range(max(1, factor), 0, -1) if unit % f == 0)

    def _classified(self, q: PatternQuery, intervals: list[tuple[int, int]], factor: int, slack: float) -> tuple[DataFrame, DataFrame]:
        """(confident, ambiguous) longest matches by bounds that don't overlap, over intervals; b counts units from the epoch."""
        sub = self.cache.aggregate(q.measure, intervals[0][0], intervals[-1][1], q.unit // factor, intervals)
        found = patterns.relaxed(sub, factor, q.parts, 1 - slack)
        best = patterns.without_overlap(patterns.select(found))
        best = workspace.written(best.select("id", "b", "to", "lens", "overshoot", "confident"), "classified")
        return best.where("confident"), best.where("NOT confident")

    def _counts(self, sure: DataFrame, doubt: DataFrame) -> tuple[float, int, int]:
        r = patterns.decision_error(sure.unionByName(doubt)).first()
        return r["error"], r["confident"], r["ambiguous"]

    def _regions(self, doubt: DataFrame, q: PatternQuery, low: int, high: int, pad: int) -> list[tuple[int, int]]:
        """Where ambiguous matches are, padded: at most as many as there are units."""
        t = patterns.ambiguous_regions(doubt, None, pad // q.unit, high // q.unit, 10)
        pairs = sorted((max(low, r["low"] * q.unit), r["high"] * q.unit) for r in t.select("low", "high").collect())
        return group_intervals(pairs, 0)

    def exact_pattern(self, q: PatternQuery, intervals: list[tuple[int, int]] | None = None) -> DataFrame:
        """(id, b, to, lens) of the longest matches that don't overlap, by exact slopes; lens is empty for patterns with repetition."""
        span = align(max(q.low, self.first), min(q.high, self.last), q.unit)
        holds = None
        for a, z in intervals or [span]:
            h = (F.col("ts_ms") >= a) & (F.col("ts_ms") < z)
            holds = h if holds is None else holds | h
        points = within(self.series, *span).where((F.col("id") == q.measure) & holds)
        sums = buckets.regression_sums(points, q.unit, 0)
        if all(isinstance(s, patterns.Segment) and s.at_least == s.at_most == 1 for s in q.parts):
            return patterns.without_overlap(patterns.select(patterns.matches(sums, q.parts))).select("id", "b", "to", "lens")
        first = span[0] // q.unit
        near = sums.withColumn("b", F.col("b") - first)
        found = patterns.regex_matches(near, q.parts, (span[1] - span[0]) // q.unit)
        return patterns.without_overlap(found).select("id", (F.col("b") + first).alias("b"), (F.col("to") + first).alias("to"), F.lit("").alias("lens"))


#: Ways to answer a query: from the cache, point by point, by four points or exact slopes read anew, by rows of non-empty buckets.
MODES = ("cache", "raw", "aggregate", "rows")


def run(engine: Engine, query: View | PatternQuery, mode: str = "cache") -> Result:
    """The result of a query in one of MODES; all but the first don't touch the cache. Rows are for patterns of fixed lengths."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "cache":
        return engine.execute(query)
    began = time.time()
    if isinstance(query, PatternQuery) and mode == "rows":
        points = within(engine.series, *align(query.low, query.high, query.unit)).where(F.col("id") == query.measure)
        rows = patterns.row_pattern(buckets.regression_sums(points, query.unit, 0), query.parts)
    elif isinstance(query, PatternQuery):
        rows = engine.exact_pattern(query)
    else:
        rows = raw(engine.series, query.measures, query.low, query.high) if mode == "raw" else engine.exact_view(query)
    kind = "view" if isinstance(query, View) else "pattern"
    return Result(rows, Metrics(kind, query.low, query.high, query.accuracy, seconds=time.time() - began))


def metrics_rows(results: Sequence[Result]) -> list[dict]:
    """Metrics of queries as numbered rows."""
    return [{"query": i} | asdict(r.metrics) for i, r in enumerate(results)]
