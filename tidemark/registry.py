"""Queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeunits import DAY, HOUR, align
from tidemark.operators import buckets, patterns, shapes, slopes, visual
from tidemark.plans import scoring, workload
from tidemark.plans.coverage import Cache
from tidemark.sources import series as src
from tidemark.streaming import rollup

#: Where the test series begins, and its length in days.
ORIGIN, DAYS = 1_704_067_200_000, 30
UNIT = 4 * HOUR
N = DAYS * DAY // UNIT

QUERIES: dict = {}
ORACLE_SQL: dict = {}

S = "s AS (SELECT epoch_us(ts) // 1000 AS ts_ms, event_type AS id, value FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def b(width: int) -> str:
    return f"(ts_ms - {ORIGIN}) // {width}"


@query(f"WITH {S} SELECT id, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM s GROUP BY id")
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return src.metadata(src.from_events(spark, sf))


A1, A2, A3 = src.Interval(ORIGIN + 2 * DAY, ORIGIN + 5 * DAY), src.Interval(ORIGIN + 9 * DAY, ORIGIN + 10 * DAY), src.Interval(ORIGIN, ORIGIN + 12 * HOUR)


@query(f"WITH {S} SELECT ts_ms, id, value FROM s WHERE id = 'click' AND ts_ms >= {A1.low} AND ts_ms < {A1.high}")
def raw_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return src.scan(src.from_events(spark, sf), {"click": [A1]})


@query(f"WITH {S} SELECT ts_ms, id, value FROM s WHERE (id = 'click' AND (ts_ms >= {A1.low} AND ts_ms < {A1.high} OR ts_ms >= {A2.low} AND ts_ms < {A2.high})) OR (id = 'view' AND ts_ms >= {A3.low} AND ts_ms < {A3.high})")
def multi_interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return src.scan(src.from_events(spark, sf), {"click": [A1, A2], "view": [A3]})


def _sample(low: int, high: int) -> str:
    return f"WITH {S}, h AS (SELECT id, {b(DAY)} AS b, ts_ms, value, ((ts_ms % 2147483647) * 2654435761) % 2147483647 AS h FROM s), r AS (SELECT id, b, ts_ms, value, CAST(row_number() OVER (PARTITION BY id, b ORDER BY h, ts_ms, value) AS INTEGER) AS r FROM h) SELECT * FROM r WHERE r > {low} AND r <= {high}"


@query(_sample(0, 5))
def hash_rank_sample(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.rank_sample(src.from_events(spark, sf), DAY, ORIGIN, 0, 5)


@query(_sample(5, 10))
def sample_extend_delta(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.rank_sample(src.from_events(spark, sf), DAY, ORIGIN, 5, 10)


AGG = "min(value) AS mn, max(value) AS mx, count(*) AS n, round(sum(value), 6) AS sm"


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {AGG} FROM s GROUP BY ALL")
def bucket_minmax_count_sum(spark: SparkSession, sf: str) -> DataFrame:
    t = buckets.aggregate(src.from_events(spark, sf), UNIT, ORIGIN)
    return t.withColumn("sm", F.round("sm", 6))


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {AGG} FROM s GROUP BY ALL")
def rollup_minmax(spark: SparkSession, sf: str) -> DataFrame:
    t = buckets.roll_up(buckets.aggregate(src.from_events(spark, sf), HOUR, ORIGIN), UNIT // HOUR)
    return t.withColumn("sm", F.round("sm", 6))


def _four(width: int) -> str:
    w = "OVER (PARTITION BY id, b ORDER BY"
    r = f"WITH {S}, t AS (SELECT id, {b(width)} AS b, ts_ms, value FROM s), r AS (SELECT *, row_number() {w} ts_ms, value) AS f, row_number() {w} ts_ms DESC, value) AS l, row_number() {w} value, ts_ms) AS m, row_number() {w} value DESC, ts_ms) AS x FROM t) SELECT id, b, count(*) AS n"
    return r + "".join(f", max(CASE WHEN {c} = 1 THEN ts_ms END) AS {k}_ms, max(CASE WHEN {c} = 1 THEN value END) AS {k}_v" for k, c in (("first", "f"), ("last", "l"), ("min", "m"), ("max", "x"))) + " FROM r GROUP BY id, b"


@query(_four(UNIT))
def m4_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.four_points(src.from_events(spark, sf), UNIT, ORIGIN)


@query(_four(UNIT))
def rollup_m4(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.roll_up_points(buckets.four_points(src.from_events(spark, sf), HOUR, ORIGIN), UNIT // HOUR)


@query(f"SELECT id, b, first_v, last_v FROM ({_four(DAY)})")
def bucket_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.four_points(src.from_events(spark, sf), DAY, ORIGIN).select("id", "b", "first_v", "last_v")


X = f"(((ts_ms - {ORIGIN}) % {UNIT}) / {UNIT}.0)"
SUMS = f"count(*) AS n, sum({X}) AS sx, sum(value) AS sy, sum({X} * value) AS sxy, sum({X} * {X}) AS sxx, sum(value * value) AS syy, min(value) AS mn, max(value) AS mx"
R = ", ".join(f"round({c}, 4) AS {c}" for c in ("sx", "sy", "sxy", "sxx", "syy"))
O = f"o AS (SELECT *, b AS ob FROM (SELECT id, {b(UNIT)} AS b, {SUMS} FROM s GROUP BY ALL))"
OLS = f"WITH {S}, {O}"


@query(f"{OLS} SELECT id, b, n, {R} FROM o")
def ols_sums(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.regression_sums(src.from_events(spark, sf), UNIT, ORIGIN).drop("mn", "mx"), 4)


@query(f"{OLS} SELECT id, b, n, {R}, round(mn, 4) AS mn, round(mx, 4) AS mx FROM o")
def ols_sums_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(buckets.regression_sums(src.from_events(spark, sf), UNIT, ORIGIN), 4)


@query(f"{OLS} SELECT id, b, n, round(degrees(atan((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0))), 3) AS angle FROM o WHERE n > 1")
def rollup_ols(spark: SparkSession, sf: str) -> DataFrame:
    t = buckets.roll_up_sums(buckets.regression_sums(src.from_events(spark, sf), HOUR, ORIGIN), UNIT // HOUR)
    return t.where("n > 1").select("id", "b", "n", F.round(slopes.angle(*map(F.col, ("n", "sx", "sy", "sxy", "sxx"))), 3).alias("angle"))


@query("SELECT l_orderkey, l_linenumber, id, CAST(value AS DOUBLE) AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR id IN (l_quantity, l_discount, l_tax))")
def unpivot_long(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_wide(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


GRID = f"g AS (SELECT id, b FROM (SELECT DISTINCT id FROM s), (SELECT unnest(range(0, {DAYS * 24})) AS b))"


@query(f"WITH {S}, {GRID}, a AS (SELECT id, {b(HOUR)} AS b, avg(value) AS mean FROM s GROUP BY ALL) SELECT id, b, round(mean, 6) AS mean FROM g LEFT JOIN a USING (id, b)")
def bucket_mean_dense(spark: SparkSession, sf: str) -> DataFrame:
    t = buckets.aggregate(src.from_events(spark, sf), HOUR, ORIGIN)
    return buckets.dense(t.select("id", "b", F.round(F.col("sm") / F.col("n"), 6).alias("mean")), DAYS * 24)


@query(f"WITH {S}, a AS (SELECT id, {b(UNIT)} AS b, avg(value) AS y FROM s GROUP BY ALL), w AS (SELECT id, b, regr_slope(y, b) OVER f AS slope, count(*) OVER f AS k, min(b) OVER f AS lo FROM a WINDOW f AS (PARTITION BY id ORDER BY b ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT id, b, round(slope, 6) AS slope FROM w WHERE k = 5")
def sliding_ols(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    t = buckets.aggregate(src.from_events(spark, sf), UNIT, ORIGIN).select("id", "b", (F.col("sm") / F.col("n")).alias("y"))
    f = Window.partitionBy("id").orderBy("b").rowsBetween(-2, 2)
    got = t.select("id", "b", F.regr_slope("y", F.col("b").cast("double")).over(f).alias("slope"), F.count("*").over(f).alias("k"))
    return got.where("k = 5").select("id", "b", F.round("slope", 6).alias("slope"))


def _runs(lo: int, hi: int, name: str = "r") -> str:
    """Runs of buckets as a table `name` (id, b, len, angle); x counts from the beginning of each run."""
    sums = "sum(y.n) AS n, sum(y.sx + d * y.n) AS sx, sum(y.sy) AS sy, sum(y.sxy + d * y.sy) AS sxy, sum(y.sxx + 2 * d * y.sx + d * d * y.n) AS sxx"
    return (
        f"{name} AS (SELECT id, b, len, degrees(atan((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0))) AS angle "
        f"FROM (SELECT y.id, y.x_b AS b, y.len, {sums}, count(*) AS k FROM (SELECT y.*, x.b AS x_b, l.len, y.ob - x.ob AS d "
        f"FROM (SELECT id, b, ob FROM o WHERE b >= 0 AND b < {N}) x, (SELECT unnest(range({lo}, {hi + 1})) AS len) l "
        f"JOIN o y ON y.id = x.id AND y.b >= x.b AND y.b < x.b + l.len WHERE y.b < {N}) y GROUP BY ALL) WHERE k = len AND n > 1)"
    )


@query(f"{OLS}, {_runs(6, 6)} SELECT id, b, round(angle, 4) AS angle FROM r WHERE angle IS NOT NULL")
def ols_angle_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = patterns.grid(src.from_events(spark, sf), UNIT, ORIGIN, N)
    return slopes.runs(g, 6, 6).select("id", "b", F.round("angle", 4).alias("angle"))


FACTOR, LENGTH = 4, 6


def _interval(factor: int = FACTOR) -> str:
    """Bounds of runs of LENGTH buckets that all hold points, empty sub-buckets passed over, as a table i; undefined ones have null ends."""
    h = 0.5 / factor
    ends = ", ".join(f"(sxy {e} exy) / (sxx {d})" for e in "-+" for d in ("- edn", "+ edn + eup"))
    known = "subs > 1 AND nn > 1 AND sxx > 0"
    return (
        f"WITH {S}, u AS (SELECT id, {b(UNIT // factor)} AS q, min(value) AS mn, max(value) AS mx, count(*) AS n, sum(value) AS sm FROM s GROUP BY ALL), "
        f"st AS (SELECT DISTINCT id, q // {factor} AS b FROM u), "
        f"p AS (SELECT st.id, st.b, u.q, CAST(u.n AS DOUBLE) AS w, (u.q + 0.5) / {factor} - st.b AS m, u.sm / u.n AS y, "
        "greatest(u.mx - u.sm / u.n, u.sm / u.n - u.mn) AS d, u.sm AS sm "
        f"FROM st JOIN u ON u.id = st.id AND u.q >= st.b * {factor} AND u.q < (st.b + {LENGTH}) * {factor}), "
        "a AS (SELECT id, b, count(*) AS subs, sum(w) AS nn, sum(w * m) / sum(w) AS xm, sum(sm) / sum(w) AS ym FROM p "
        f"GROUP BY ALL HAVING count(DISTINCT q // {factor}) = {LENGTH}), "
        "z AS (SELECT id, b, max(subs) AS subs, max(nn) AS nn, sum(w * (m - xm) * (m - xm)) AS sxx, sum(w * (m - xm) * (y - ym)) AS sxy, "
        f"sum(w * abs(y - ym) * {h} + w * 2 * {h} * d) AS exy, sum(w * abs(m - xm) * 2 * {h}) AS edn, "
        f"sum(w * (2 * {h}) * (2 * {h}) + w * {h} * {h}) AS eup FROM p JOIN a USING (id, b) GROUP BY ALL), "
        f"i AS (SELECT id, b, CASE WHEN {known} THEN degrees(atan(sxy / sxx)) END AS est, {known} AND sxx - edn > 0 AS defined, "
        f"CASE WHEN {known} AND sxx - edn > 0 THEN degrees(atan(least({ends}))) END AS lo, "
        f"CASE WHEN {known} AND sxx - edn > 0 THEN degrees(atan(greatest({ends}))) END AS hi FROM z)"
    )


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    return slopes.interval(buckets.aggregate(src.from_events(spark, sf), UNIT // FACTOR, ORIGIN), FACTOR, LENGTH)


@query(f"{_interval()} SELECT id, b, round(est, 4) AS est, round(lo, 4) AS lo, round(hi, 4) AS hi, defined FROM i")
def slope_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_bounds(spark, sf), 4)


@query(
    f"{_interval()}, {O}, {_runs(LENGTH, LENGTH)} SELECT id, count(*) AS windows, CAST(count_if(defined) AS BIGINT) AS defined, "
    "CAST(count_if(defined AND r.angle BETWEEN i.lo - 1e-9 AND i.hi + 1e-9) AS BIGINT) AS inside FROM i JOIN r USING (id, b) GROUP BY id"
)
def bound_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Exact slopes of all windows held against their bounds."""
    exact = slopes.runs(patterns.grid(src.from_events(spark, sf), UNIT, ORIGIN, N), LENGTH, LENGTH)
    inside = F.col("defined") & (F.col("angle") >= F.col("lo") - 1e-9) & (F.col("angle") <= F.col("hi") + 1e-9)
    held = _bounds(spark, sf).join(exact, ["id", "b"]).groupBy("id")
    return held.agg(F.count("*").alias("windows"), F.count_if("defined").alias("defined"), F.count_if(inside).alias("inside"))


@query(
    f"WITH {S}, u AS (SELECT id, {b(HOUR)} AS h, min(value) AS y0, max(value) AS y1, avg(value) AS y FROM s GROUP BY ALL), "
    "j AS (SELECT a.id, a.h AS start, c.h - a.h AS k, c.y0, c.y1, c.y FROM u a JOIN u c ON c.id = a.id AND c.h >= a.h AND c.h < a.h + 6), "
    "m AS (SELECT id, start, avg(k) AS xm FROM j GROUP BY ALL HAVING count(*) = 6), "
    "v AS (SELECT id, start, sum((k - xm) * y) AS s, sum((k - xm) * CASE WHEN k > xm THEN y0 ELSE y1 END) AS lo, "
    "sum((k - xm) * CASE WHEN k > xm THEN y1 ELSE y0 END) AS hi FROM j JOIN m USING (id, start) GROUP BY ALL) "
    "SELECT id, count(*) AS windows, CAST(count_if(s BETWEEN lo - 1e-9 AND hi + 1e-9) AS BIGINT) AS inside FROM v GROUP BY id"
)
def vertex_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of the means of six hours held against the vertex bounds of their minima and maxima."""
    t = buckets.aggregate(src.from_events(spark, sf), HOUR, ORIGIN)
    starts = t.select("id", "b", "mn", "mx", (F.col("sm") / F.col("n")).alias("y"), F.explode(F.sequence(F.col("b") - 5, F.col("b"))).alias("start"))
    whole = starts.groupBy("id", "start").agg(F.count("*").alias("k"), F.regr_slope("y", (F.col("b") - F.col("start")).cast("double")).alias("slope")).where("k = 6 AND start >= 0")
    points = starts.select("id", "start", (F.col("b") - F.col("start")).cast("double").alias("x"), F.col("mn").alias("y_min"), F.col("mx").alias("y_max"))
    held = slopes.vertex_bounds(points, "id", "start").join(whole, ["id", "start"])
    inside = (F.col("slope") >= F.col("lo") - 1e-9) & (F.col("slope") <= F.col("hi") + 1e-9)
    return held.groupBy("id").agg(F.count("*").alias("windows"), F.count_if(inside).alias("inside"))


RELAXED = "least(1.0, (greatest(0.0, 20 - lo) + greatest(0.0, hi - 80)) / (hi - lo))"


#: Windows that may lie in [20, 80], as a table c (id, b, o): o is null where the bounds are undefined.
CLASSED = f"c AS (SELECT id, b, CASE WHEN NOT defined THEN NULL WHEN hi > lo THEN {RELAXED} ELSE 0.0 END AS o FROM i WHERE NOT defined OR hi >= 20 AND lo <= 80)"


@query(f"{_interval()}, {CLASSED} SELECT id, b, round(o, 6) AS overshoot, coalesce(o <= 0.5, false) AS confident FROM c")
def pattern_relaxed_classified(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.classified(_bounds(spark, sf), 20, 80, 0.5).select("id", "b", F.round("overshoot", 6).alias("overshoot"), "confident")


@query(
    f"{_interval()}, {CLASSED} SELECT round(sum(CASE WHEN coalesce(o, 1.0) > 0.5 THEN coalesce(o, 1.0) ELSE 0.0 END) / count(*), 6) AS error, "
    "CAST(count_if(coalesce(o, 1.0) <= 0.5) AS BIGINT) AS confident, CAST(count_if(coalesce(o, 1.0) > 0.5) AS BIGINT) AS ambiguous FROM c"
)
def decision_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(patterns.decision_error(patterns.classified(_bounds(spark, sf), 20, 80, 0.5)))


@query(f"WITH {S}, p AS (SELECT id, {b(DAY)} AS b, QQQ AS q, min(value) AS lo0, max(value) AS hi0 FROM s GROUP BY ALL), m AS (SELECT id, b, avg(q) AS xm FROM p GROUP BY ALL HAVING count(*) > 1), j AS (SELECT p.*, q - xm AS xc FROM p JOIN m USING (id, b)) SELECT id, b, round(sum(xc * CASE WHEN xc > 0 THEN lo0 WHEN xc < 0 THEN hi0 ELSE (lo0 + hi0) / 2 END) / sum(xc * xc), 6) AS lo, round(sum(xc * CASE WHEN xc > 0 THEN hi0 WHEN xc < 0 THEN lo0 ELSE (lo0 + hi0) / 2 END) / sum(xc * xc), 6) AS hi FROM j GROUP BY id, b".replace("QQQ", b(UNIT)))
def vertex_slope_bounds(spark: SparkSession, sf: str) -> DataFrame:
    t = buckets.aggregate(src.from_events(spark, sf), UNIT, ORIGIN)
    pts = t.select("id", F.floor(F.col("b") / (DAY // UNIT)).cast("long").alias("b"), F.col("b").cast("double").alias("x"), F.col("mn").alias("y_min"), F.col("mx").alias("y_max"))
    return rounded(slopes.vertex_bounds(pts, "id", "b"))


@query(
    f"WITH {S}, o AS (SELECT id, {b(DAY)} AS b, count(*) AS n, sum(x) AS sx, sum(value) AS sy, sum(x * value) AS sxy, sum(x * x) AS sxx, sum(value * value) AS syy FROM (SELECT *, (ts_ms - {ORIGIN}) / {DAY}.0 AS x FROM s) GROUP BY ALL), "
    "c AS (SELECT id, b, n, sxx - sx * sx / n AS xx, sxy - sx * sy / n AS xy, syy - sy * sy / n AS yy FROM o WHERE n > 1), e AS (SELECT id, b, n, xy / xx AS k, CASE WHEN n > 2 THEN sqrt(greatest(0.0, yy - xy / xx * xy) / (n - 2) / xx) ELSE 0.0 END AS se FROM c WHERE xx > 0) SELECT id, b, n, round(degrees(atan(k)), 3) AS est, round(degrees(atan(k - 1.96 * se)), 3) AS lo, round(degrees(atan(k + 1.96 * se)), 3) AS hi FROM e"
)
def sampled_ols_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slopes.sampled_ci(buckets.regression_sums(src.from_events(spark, sf), DAY, ORIGIN)), 3)


def _matches(segments: list[patterns.Segment]) -> str:
    """All matches as a table m (id, b, z, lens, a0)."""
    parts, froms, where, at = [OLS], [], [], "r0.b"
    for i, s in enumerate(segments):
        parts.append(_runs(s.shortest, s.longest, f"q{i}") + f", r{i} AS (SELECT * FROM q{i} WHERE angle BETWEEN {s.low} AND {s.high})")
        froms.append(f"r{i}")
        if i:
            where += [f"r{i}.id = r0.id", f"r{i}.b = {at}"]
        at += f" + r{i}.len"
    lens = " || '-' || ".join(f"lpad(CAST(r{i}.len AS VARCHAR), 3, '0')" for i in range(len(segments)))
    return ", ".join(parts) + f", m AS (SELECT r0.id, r0.b, {at} AS z, {lens} AS lens, r0.angle AS a0 FROM {', '.join(froms)}{' WHERE ' + ' AND '.join(where) if where else ''})"


OUT = "SELECT id, b, z, lens, round(a0, 4) AS a0"
BEST = "t AS (SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY z - b {}, lens) AS r FROM m), k AS (SELECT id, b, z, lens, a0 FROM t WHERE r = 1)"
GREEDY = ", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) AS r FROM k) WHERE r = 1 UNION ALL SELECT k.id, k.b, k.z, k.lens, k.a0, 1 FROM w, LATERAL (SELECT * FROM k WHERE k.id = w.id AND k.b >= w.z ORDER BY k.b LIMIT 1) k)"

UP_DOWN = patterns.parse("6:20:89;6:-89:-20")
FLEXIBLE = patterns.parse("3-6:20:89;3-6:-89:-20")
FOUR = patterns.parse("2-3:20:89;2-3:-89:-20;2-3:20:89;2-3:-89:-20")
PLATEAU = patterns.parse("3-5:10:89;3-5:-60:60;3-5:-89:-10")


def _found(spark: SparkSession, sf: str, segments: list[patterns.Segment]) -> DataFrame:
    return patterns.matches(patterns.grid(src.from_events(spark, sf), UNIT, ORIGIN, N), segments, N)


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", "b", F.col("to").alias("z"), "lens", F.round("a0", 4).alias("a0"))


def _greedy_sql(segments: list[patterns.Segment], order: str) -> str:
    sql = _matches(segments) + ", " + BEST.format(order) + GREEDY + f" {OUT} FROM w"
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _pattern(name: str, segments: list[patterns.Segment], mode: str) -> None:
    if mode == "all":
        f, sql = (lambda spark, sf: _out(_found(spark, sf, segments))), f"{_matches(segments)} {OUT} FROM m"
    elif mode == "each start":
        f, sql = (lambda spark, sf: _out(patterns.select(_found(spark, sf, segments)))), f"{_matches(segments)}, {BEST.format('DESC')} {OUT} FROM k"
    else:
        longest = mode == "longest"
        f, sql = (lambda spark, sf: _out(patterns.without_overlap(patterns.select(_found(spark, sf, segments), longest)))), _greedy_sql(segments, "DESC" if longest else "ASC")
    QUERIES[name], ORACLE_SQL[name] = f, sql


_pattern("pattern_exact_two_seg", UP_DOWN, "longest")
_pattern("pattern_all_matches", UP_DOWN, "all")
_pattern("pattern_var_length", FLEXIBLE, "all")
_pattern("pattern_longest_nonoverlap", FLEXIBLE, "longest")
_pattern("pattern_shortest", FLEXIBLE, "shortest")
_pattern("pattern_skip_to_next", FLEXIBLE, "each start")
_pattern("pattern_four_seg", FOUR, "longest")
_pattern("predefined_v_shape", patterns.parse("3-5:-89:-20;3-5:20:89"), "longest")
_pattern("predefined_plateau", PLATEAU, "longest")
_pattern("predefined_oscillating", FOUR, "all")

WIDTH, HEIGHT = 100, 60
STEP = DAYS * DAY // WIDTH


@query(f"SELECT DISTINCT id, b, ts_ms, value FROM (SELECT id, b, unnest([first_ms, min_ms, max_ms, last_ms]) AS ts_ms, unnest([first_v, min_v, max_v, last_v]) AS value FROM ({_four(STEP)}) WHERE b >= 0 AND b < {WIDTH})")
def visual_m4_points(spark: SparkSession, sf: str) -> DataFrame:
    return visual.points(visual.columns(src.from_events(spark, sf), ORIGIN, ORIGIN + DAYS * DAY, WIDTH))


@query(f"SELECT DISTINCT id, b, ts_ms, value FROM (SELECT id, b, unnest([min_ms, max_ms]) AS ts_ms, unnest([min_v, max_v]) AS value FROM ({_four(STEP)}) WHERE b >= 0 AND b < {WIDTH})")
def visual_minmax_points(spark: SparkSession, sf: str) -> DataFrame:
    return visual.points(visual.columns(src.from_events(spark, sf), ORIGIN, ORIGIN + DAYS * DAY, WIDTH), ("min", "max"))


@query(f"WITH {S} SELECT ts_ms, id, value FROM s WHERE ts_ms >= {ORIGIN} AND ts_ms < {ORIGIN + DAYS * DAY}")
def visual_raw(spark: SparkSession, sf: str) -> DataFrame:
    every = src.Interval(ORIGIN, ORIGIN + DAYS * DAY)
    return src.from_events(spark, sf).where(every.holds()).select("ts_ms", "id", "value")


@query(f"SELECT id, count(*) AS columns, min(min_v) AS mn, max(max_v) AS mx, round(sum(min_v + max_v), 4) AS total FROM ({_four(STEP)}) WHERE b >= 0 AND b < {WIDTH} GROUP BY id")
def measure_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = visual.summary(visual.columns(src.from_events(spark, sf), ORIGIN, ORIGIN + DAYS * DAY, WIDTH))
    return t.withColumn("total", F.round("total", 4))


def _raster(width: int) -> str:
    return f"(SELECT id, b AS px, unnest(range(CAST(floor({HEIGHT - 1} * (min_v - lo) / (hi - lo)) AS BIGINT), CAST(floor({HEIGHT - 1} * (max_v - lo) / (hi - lo)) AS BIGINT) + 1)) AS py FROM (SELECT *, min(min_v) OVER (PARTITION BY id) AS lo, max(max_v) OVER (PARTITION BY id) AS hi FROM ({_four(width)}) WHERE b >= 0 AND b < {DAYS * DAY // width}))"


@query(f"SELECT id, px, py FROM {_raster(STEP)}")
def pixel_columns(spark: SparkSession, sf: str) -> DataFrame:
    return visual.raster(src.from_events(spark, sf), ORIGIN, ORIGIN + DAYS * DAY, WIDTH, HEIGHT).withColumn("py", F.col("py").cast("long"))


@query(f"WITH x AS {_raster(STEP)}, y AS {_raster(STEP * 2)}, a AS (SELECT coalesce(x.id, y.id) AS id, x.px IS NULL OR y.px IS NULL AS d FROM x FULL JOIN y ON x.id = y.id AND x.px = y.px AND x.py = y.py) SELECT id, CAST(sum(CASE WHEN d THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) AS either FROM a GROUP BY id")
def pixel_diff(spark: SparkSession, sf: str) -> DataFrame:
    s = src.from_events(spark, sf)
    return visual.pixel_diff(visual.raster(s, ORIGIN, ORIGIN + DAYS * DAY, WIDTH, HEIGHT), visual.raster(s, ORIGIN, ORIGIN + DAYS * DAY, WIDTH // 2, HEIGHT))


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {AGG} FROM s WHERE (id = 'click' AND ts_ms < {ORIGIN + 10 * DAY}) OR (id = 'view' AND ts_ms >= {ORIGIN + 5 * DAY}) GROUP BY ALL")
def per_measure_intervals(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"click": [src.Interval(0, ORIGIN + 10 * DAY)], "view": [src.Interval(ORIGIN + 5 * DAY, ORIGIN + 400 * DAY)]}
    t = buckets.aggregate(src.scan(src.from_events(spark, sf), wanted), UNIT, ORIGIN)
    return t.withColumn("sm", F.round("sm", 6))


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {AGG} FROM s WHERE id = 'click' AND ts_ms >= {ORIGIN} AND ts_ms < {ORIGIN + 20 * DAY} GROUP BY ALL")
def cached_equals_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The second of two overlapping requests, answered in part by what the first, at narrower buckets, has left."""
    cache = Cache(src.from_events(spark, sf), ORIGIN)
    cache.aggregate("click", ORIGIN, ORIGIN + 12 * DAY, HOUR).count()
    t = cache.aggregate("click", ORIGIN, ORIGIN + 20 * DAY, UNIT)
    return t.withColumn("sm", F.round("sm", 6))


EIGHT = patterns.parse(";".join(["2:10:89", "2:-89:-10"] * 4))
_pattern("pattern_eight_seg", EIGHT, "longest")


def _either(name: str, choices: list[list[patterns.Segment]]) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return _out(patterns.alternatives(patterns.grid(src.from_events(spark, sf), UNIT, ORIGIN, N), choices, N))

    QUERIES[name], ORACLE_SQL[name] = f, " UNION ".join(f"SELECT * FROM ({_matches(c)} {OUT} FROM m)" for c in choices)


_either("pattern_repetition", patterns.repeat(patterns.parse("2-3:20:89"), 1, 3))
_either("pattern_group", [c + patterns.parse("2:20:89") for c in patterns.repeat(patterns.parse("2-3:20:89;2:-89:-20"), 1, 2)])

HOURLY = SUMS.replace(str(UNIT), str(HOUR))
NON_EMPTY = f"WITH {S}, o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ob) - 1 AS b, ob, * EXCLUDE (id, ob) FROM (SELECT id, {b(HOUR)} AS ob, {HOURLY} FROM s GROUP BY ALL))"


@query(_matches(UP_DOWN).replace(OLS, NON_EMPTY).replace(f"< {N}", f"< {DAYS * 24}") + f" {OUT} FROM m")
def row_pattern_sql(spark: SparkSession, sf: str) -> DataFrame:
    sums = buckets.regression_sums(src.from_events(spark, sf), HOUR, ORIGIN)
    return _out(patterns.row_pattern(sums, UP_DOWN))


DOUBTFUL = f"{CLASSED}, d AS (SELECT id, greatest(b - 2, 0) AS low, least(b + {LENGTH + 2}, {N}) AS high FROM c WHERE coalesce(o, 1.0) > 0.5)"


@query(f"{_interval()}, {DOUBTFUL}, e AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM d), f AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT id, CAST(min(low) AS BIGINT) AS low, CAST(max(high) AS BIGINT) AS high FROM f GROUP BY id, k")
def ambiguous_regions(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.ambiguous_regions(patterns.classified(_bounds(spark, sf), 20, 80, 0.5), LENGTH, 2, N)


ALPHAS = (2, 4, 8)


WIDTH_OF = "count(*) AS windows, round(avg(hi - lo), 4) AS mean_width, round(quantile_cont(hi - lo, 0.5), 4) AS median_width, round(quantile_cont(hi - lo, 0.95), 4) AS p95_width, round(avg(CASE WHEN defined THEN 0.0 ELSE 1.0 END), 6) AS undefined"


@query(" UNION ALL ".join(f"SELECT {a} AS factor, {WIDTH_OF} FROM ({_interval(a)} SELECT * FROM i)" for a in ALPHAS))
def bound_width_by_alpha(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for a in ALPHAS:
        t = scoring.tightness(slopes.interval(buckets.aggregate(src.from_events(spark, sf), UNIT // a, ORIGIN), a, LENGTH))
        t = t.select(F.lit(a).alias("factor"), "windows", *(F.round(c, 4).alias(c) for c in ("mean_width", "median_width", "p95_width")), F.round("undefined", 6).alias("undefined"))
        out = t if out is None else out.unionByName(t)
    return out


@query(f"WITH {S} SELECT id, min(ts_ms) // {UNIT} * {UNIT} AS low, (max(ts_ms) // {UNIT} + 1) * {UNIT} AS high FROM s GROUP BY id")
def align_bounds(spark: SparkSession, sf: str) -> DataFrame:
    # One row for each id.
    rows = [(r["id"], *align(r["first_ms"], r["last_ms"] + 1, UNIT)) for r in src.metadata(src.from_events(spark, sf)).collect()]
    return spark.createDataFrame(rows, "id string, low bigint, high bigint")


@query(f"{_matches(UP_DOWN)} {OUT} FROM m WHERE id = 'click'")
def pattern_cached_equals_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact search over sums of which the cache held a part, at narrower buckets."""
    cache = Cache(src.from_events(spark, sf), ORIGIN, kind="regression")
    cache.aggregate("click", ORIGIN, ORIGIN + 12 * DAY, HOUR)
    sums = cache.aggregate("click", ORIGIN, ORIGIN + DAYS * DAY, UNIT)
    return _out(patterns.matches(sums, UP_DOWN, N))


@query(f"WITH {S}, r AS (SELECT id, min(ts_ms) // {DAY} * {DAY} AS low FROM s GROUP BY id), a AS (SELECT id, low + 12 * {DAY} AS kept, low + 20 * {DAY} AS high, low FROM r) SELECT id, round((kept - low) / (kept - low + high - low), 6) AS hit_ratio FROM a")
def cache_hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty days asked after twelve were kept, from the first day of each measure."""
    s, rows = src.from_events(spark, sf), []
    for r in src.metadata(s).collect():  # a row for each measure
        low = r["first_ms"] // DAY * DAY
        with Cache(s, ORIGIN) as cache:
            cache.aggregate(r["id"], low, low + 12 * DAY, HOUR).count()
            cache.aggregate(r["id"], low, low + 20 * DAY, UNIT).count()
            rows.append((r["id"], cache.hit_ratio))
    return rounded(spark.createDataFrame(rows, "id string, hit_ratio double"))


@query()
def match_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that the bounds are sure of, held against the exact ones, within one bucket."""
    band = patterns.parse(f"{LENGTH}:20:80")
    truth = _found(spark, sf, band)
    sure = patterns.classified(_bounds(spark, sf), 20, 80, 0.5).where("confident").select("id", "b", (F.col("b") + LENGTH).alias("to"))
    return rounded(scoring.precision_recall(scoring.match_scores(truth, sure, 1)))


@query(
    "WITH c AS (SELECT event_type AS method, user_id % 5 AS run, value AS seconds, CASE WHEN user_id % 9 = 0 THEN -1 ELSE user_id END AS cache_bytes FROM events), "
    "r AS (SELECT method, run, count(*) AS queries, sum(seconds) AS total, avg(seconds) AS mean, quantile_cont(seconds, 0.95) AS p95, max(CASE WHEN cache_bytes >= 0 THEN cache_bytes END) AS cache_bytes FROM c GROUP BY ALL) "
    "SELECT method, count(*) AS runs, round(avg(queries), 4) AS queries, round(avg(total), 4) AS total, round(avg(mean), 4) AS mean, round(avg(p95), 4) AS p95, max(cache_bytes) AS cache_bytes FROM r GROUP BY method"
)
def method_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    e, u = spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")
    known = F.when(u % 9 == 0, -1).otherwise(u).alias("cache_bytes")
    return rounded(scoring.cost_summary(e.select(F.col("event_type").alias("method"), (u % 5).alias("run"), F.col("value").alias("seconds"), known)), 4)


@query(
    f"{_interval()}, {CLASSED}, k AS (SELECT unnest(range(0, 11)) / 10.0 AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, "
    "round(avg(CASE WHEN o <= threshold THEN 1.0 ELSE 0.0 END), 6) AS covered, round(avg(CASE WHEN o <= threshold THEN o END), 6) AS risk FROM k, c GROUP BY threshold"
)
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.risk_coverage(patterns.classified(_bounds(spark, sf), 20, 80, 0.5)))


@query(
    f"WITH RECURSIVE {S}, a AS (SELECT id, {b(UNIT)} AS b, avg(value) AS y FROM s GROUP BY ALL), t AS (SELECT id, b, avg(y) OVER (PARTITION BY id ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM a), u AS (SELECT id, b, y, lead(y) OVER w AS y2, lead(b) OVER w AS b2 FROM t WINDOW w AS (PARTITION BY id ORDER BY b)), "
    "r AS (SELECT *, y2 > y AS rises FROM u WHERE y2 <> y), g AS (SELECT *, CASE WHEN lag(rises) OVER w = rises THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY id ORDER BY b)), h AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY b) AS g FROM g), "
    "i AS (SELECT id, min(b) AS b, max(b2) AS z, any_value(rises) AS rises FROM h GROUP BY id, g HAVING abs(sum(y2 - y)) >= 10), j AS (SELECT *, CASE WHEN lag(rises) OVER w = rises THEN 0 ELSE 1 END AS new FROM i WINDOW w AS (PARTITION BY id ORDER BY b)), k AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY b) AS g FROM j), "
    "l AS (SELECT id, min(b) AS b, max(z) AS z, any_value(rises) AS rises FROM k GROUP BY id, g), p AS (SELECT id, b, rises, lead(z) OVER w AS two, lead(z, 3) OVER w AS four, lead(z, 7) OVER w AS eight FROM l WINDOW w AS (PARTITION BY id ORDER BY b)), "
    "c AS (SELECT id, b, CASE WHEN rises AND eight IS NOT NULL THEN eight WHEN rises THEN coalesce(four, two) ELSE two END AS z, "
    "CASE WHEN NOT rises THEN 'v_shape' WHEN eight IS NOT NULL THEN 'sawtooth' WHEN four IS NOT NULL THEN 'double_peak' ELSE 'triangle' END AS shape FROM p WHERE two IS NOT NULL), "
    "w AS (SELECT id, b, z, shape FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) AS r FROM c) WHERE r = 1 "
    "UNION ALL SELECT c.id, c.b, c.z, c.shape FROM w, LATERAL (SELECT * FROM c WHERE c.id = w.id AND c.b >= w.z ORDER BY c.b LIMIT 1) c) SELECT * FROM w"
)
def shape_detector(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.shapes(buckets.aggregate(src.from_events(spark, sf), UNIT, ORIGIN), 10).withColumnRenamed("to", "z")


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {AGG} FROM s GROUP BY ALL")
def stream_rollup(spark: SparkSession, sf: str) -> DataFrame:
    path = rollup.fresh(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # The stream reads the folder of tables, and of it this one.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rollup.follow(src.from_long(events, "ts", "event_type", "value"), UNIT, ORIGIN, path)
    return rollup.read(spark, path).withColumn("sm", F.round("sm", 6))


@query()
def synthetic_series(spark: SparkSession, sf: str) -> DataFrame:
    return src.metadata(workload.synthetic(spark, 10_000, ORIGIN, 1000))
