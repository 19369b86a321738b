"""Queries of views, bounds over cut sub-buckets, the engine, its cache, sinks and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import registry as base
from tidemark import workspace
from tidemark.functions import timeunits
from tidemark.functions.timeunits import DAY, HOUR, MINUTE
from tidemark.operators import buckets, patterns, pixels, slopes, visual
from tidemark.plans import coverage, engine, scoring, workload
from tidemark.registry import DAYS, LENGTH, ORIGIN, UNIT, N, S, b, query, rounded
from tidemark.sources import catalog
from tidemark.sources import series as src

END = ORIGIN + DAYS * DAY
WIDTH, HEIGHT, STEP = base.WIDTH, base.HEIGHT, base.STEP


def series(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_events(spark, sf)


# Pixel errors

SUB = 2 * HOUR


def _columns_sql() -> str:
    """Columns of a view from groups of SUB as a table k, with the neighbours' values."""
    here, inside = "n > 0 AND mid >= c0 AND mid < c1", "f >= c0 AND t <= c1"
    lagged = ("n", "first_ms", "first_v", "last_ms", "last_v", "has_l", "b_mn", "b_mx", "has_b", "e_mn", "e_mx", "has_e")
    near = ", ".join(f"{f}({c}) OVER w AS {p}_{c}" for f, p in (("lag", "p"), ("lead", "q")) for c in lagged)
    return (
        f"WITH {S}, a AS (SELECT id, {b(SUB)} AS b, min(value) AS mn, max(value) AS mx, count(*) AS n FROM s GROUP BY ALL), "
        f"gr AS (SELECT id, b FROM (SELECT DISTINCT id FROM s), (SELECT unnest(range(0, {DAYS * DAY // SUB})) AS b)), "
        f"g AS (SELECT id, {ORIGIN} + b * {SUB} AS f, {ORIGIN} + (b + 1) * {SUB} AS t, {ORIGIN} + b * {SUB} + {SUB // 2} AS mid, coalesce(n, 0) AS n, mn, mx FROM gr LEFT JOIN a USING (id, b)), "
        f"r AS (SELECT *, {ORIGIN} + px * {STEP} AS c0, {ORIGIN} + (px + 1) * {STEP} AS c1 FROM (SELECT *, unnest(range((f - {ORIGIN}) // {STEP}, least((t - 1 - {ORIGIN}) // {STEP}, {WIDTH - 1}) + 1)) AS px FROM g)), "
        f"c AS (SELECT id, px, c0, c1, 2 * count(*) FILTER ({here}) AS n, min(mn) FILTER ({here}) AS mn, max(mx) FILTER ({here}) AS mx, "
        f"min(mid) FILTER ({here}) AS first_ms, arg_min(mn, mid) FILTER ({here}) AS first_v, max(mid) FILTER ({here}) AS last_ms, arg_max(mn, mid) FILTER ({here}) AS last_v, "
        f"min(f) FILTER ({inside}) AS in0, max(t) FILTER ({inside}) AS in1, sum(t - f) FILTER ({inside}) AS cov, "
        f"min(mn) FILTER ({inside} AND n > 0) AS in_mn, max(mx) FILTER ({inside} AND n > 0) AS in_mx, "
        "count(*) FILTER (f <= c0) > 0 AS has_b, max(mn) FILTER (f <= c0) AS b_mn, max(mx) FILTER (f <= c0) AS b_mx, max(t) FILTER (f <= c0) AS b_t, "
        "count(*) FILTER (t >= c1) > 0 AS has_e, max(mn) FILTER (t >= c1) AS e_mn, max(mx) FILTER (t >= c1) AS e_mx FROM r GROUP BY id, px, c0, c1), "
        "l AS (SELECT *, coalesce(in0 > c0 AND b_t >= in0, false) AS has_l, "
        "min(mn) OVER (PARTITION BY id) AS lo, max(mx) OVER (PARTITION BY id) AS hi FROM c), "
        f"k AS (SELECT *, {near} FROM l WINDOW w AS (PARTITION BY id ORDER BY px))"
    )


def _p(v: str) -> str:
    return f"CAST(floor({HEIGHT - 1} * (greatest(least({v}, hi), lo) - lo) / (hi - lo)) AS INTEGER)"


def _range(x: str, y: str) -> str:
    return f"CASE WHEN ({x}) IS NULL OR ({y}) IS NULL THEN [] ELSE range(least({_p(x)}, {_p(y)}), greatest({_p(x)}, {_p(y)}) + 1) END"


def _errors_sql() -> str:
    """The error of each column as a table e (id, px, c0, c1, error)."""
    line = lambda a, z: f"({a}_v + ({z}_v - {a}_v) / ({z}_ms - {a}_ms) * ({{}} - {a}_ms))"
    left, right = line("p_last", "first"), line("last", "q_first")
    f_left = _range(left.format("greatest(c0, p_last_ms)"), left.format("least(c1, first_ms)"))
    f_right = _range(right.format("greatest(c0, last_ms)"), right.format("least(c1, q_first_ms)"))
    cross = lambda e, z: f"list_concat({_range(z + 'b_mn', e + 'e_mx')}, {_range(z + 'b_mx', e + 'e_mn')})"
    m = lambda e, z: f"CASE WHEN {z}has_l THEN {_range(z + 'b_mn', z + 'b_mx')} WHEN {z}has_b AND {e}has_e THEN {cross(e, z)} END"
    return (
        f"{_columns_sql()}, x AS (SELECT *, CASE WHEN p_n > 0 THEN {f_left} ELSE [] END AS fl, CASE WHEN q_n > 0 THEN {f_right} ELSE [] END AS fr, "
        f"CASE WHEN p_n > 0 THEN {m('p_', '')} ELSE [] END AS ml, CASE WHEN q_n > 0 THEN {m('', 'q_')} ELSE [] END AS mr, "
        f"coalesce(in1 - in0 = cov, false) AS gapless, CASE WHEN in_mn IS NULL THEN range(1, {HEIGHT}) ELSE {_range('in_mn', 'in_mx')} END AS inner_ FROM k), "
        f"e AS (SELECT id, px, c0, c1, CASE WHEN n = 0 THEN 0.0 WHEN gapless AND ml IS NOT NULL AND mr IS NOT NULL THEN "
        f"len(list_filter(list_distinct(list_concat(list_concat(fl, fr), list_concat(ml, mr))), lambda y: NOT list_contains(inner_, y))) / {HEIGHT}.0 END AS error FROM x)"
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    table = buckets.dense(buckets.aggregate(series(spark, sf), SUB, ORIGIN), DAYS * DAY // SUB)
    return pixels.errors(pixels.columns(pixels.groups_of_extents(table, SUB, ORIGIN), ORIGIN, END, WIDTH), HEIGHT)


@query(f"{_errors_sql()} SELECT id, px, CAST(error AS DOUBLE) AS error FROM e")
def pixel_error_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("id", F.col("px").cast("long").alias("px"), "error")


@query(f"{_errors_sql()} SELECT id, count(error) AS columns, round(avg(error), 6) AS error FROM e GROUP BY id")
def pixel_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.total_error(_judged(spark, sf)))


def _islands(which: str) -> str:
    return (
        f"{_errors_sql()}, h AS (SELECT *, CASE WHEN px - lag(px) OVER (PARTITION BY id ORDER BY px) - 1 <= 10 THEN 0 ELSE 1 END AS new FROM e WHERE {which}), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY px) AS k FROM h) SELECT id, min(c0) AS low, max(c1) AS high FROM i GROUP BY id, k"
    )


@query(_islands("error > 0.2"))
def high_error_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return pixels.high_error(_judged(spark, sf), 0.2)


@query(_islands("error IS NULL"))
def inconclusive_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return pixels.inconclusive(_judged(spark, sf))


@query(
    f"WITH {S}, i AS (SELECT DISTINCT id FROM s WHERE ts_ms < {ORIGIN + 20 * DAY}), p AS (SELECT unnest(range({ORIGIN}, {ORIGIN + WIDTH * STEP}, {STEP})) AS c0) "
    f"SELECT id, min(c0) AS low, max(c0) + {STEP} AS high FROM i, p WHERE c0 >= {ORIGIN + 20 * DAY} GROUP BY id"
)
def missing_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """What a view of thirty days has to fetch when groups of the first twenty are there."""
    count = 20 * DAY // SUB
    table = buckets.dense(buckets.aggregate(src.within(series(spark, sf), ORIGIN, ORIGIN + 20 * DAY), SUB, ORIGIN), count)
    return pixels.unknown(pixels.columns(pixels.groups_of_extents(table, SUB, ORIGIN), ORIGIN, END, WIDTH))


@query()
def view_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Structural similarity of a view with the same drawn from half as many columns."""
    one = visual.raster(series(spark, sf), ORIGIN, END, WIDTH, HEIGHT)
    other = visual.raster(series(spark, sf), ORIGIN, END, WIDTH // 2, HEIGHT)
    doubled = other.select("id", F.explode(F.array(F.col("px") * 2, F.col("px") * 2 + 1)).alias("px"), "py")
    return rounded(pixels.similarity(one, doubled, WIDTH, HEIGHT))


# Bounds

CUT = 90 * MINUTE  # doesn't divide the unit


def _straddling_sql() -> str:
    """Bounds over cut sub-buckets as a table i."""
    mean, ends = "sm / w", ", ".join(f"(sxy {e} exy) / (sxx {d})" for e in "-+" for d in ("- less", "+ less + more"))
    part = ""
    for name, keep in (("0", "true"), ("1", "NOT right_"), ("2", "NOT left_"), ("3", "NOT left_ AND NOT right_")):
        part += (
            f", a{name} AS (SELECT id, b, count(*) AS subs, sum(w) AS n, sum(w * m) / sum(w) AS xm, sum(sm) / sum(w) AS ym, sum(w * h) / sum(w) AS dl FROM p WHERE {keep} GROUP BY ALL), "
            f"z{name} AS (SELECT id, b, any_value(subs) AS subs, any_value(n) AS n, sum(w * (m - xm) ** 2) AS sxx, sum(w * (m - xm) * ({mean} - ym)) AS sxy, "
            f"sum(w * h * (abs({mean} - ym) + 2 * greatest(mx - {mean}, {mean} - mn))) AS exy, sum(w * abs(m - xm) * 2 * h) AS less, sum(w * ((h + dl) ** 2 + h * h)) AS more FROM p JOIN a{name} USING (id, b) WHERE {keep} GROUP BY ALL), "
            f"e{name} AS (SELECT id, b, sxy / sxx AS est, least({ends}) AS lo, greatest({ends}) AS hi FROM z{name} WHERE subs > 1 AND n > 1 AND sxx > 0 AND sxx - less > 0)"
        )
    every = " UNION ALL ".join(f"SELECT *, {i} AS k FROM e{i}" for i in range(4))
    return (
        f"WITH {S}, q AS (SELECT id, {b(CUT)} AS q, min(value) AS mn, max(value) AS mx, count(*) AS w, sum(value) AS sm FROM s GROUP BY ALL), "
        f"u AS (SELECT *, unnest(range(q * {CUT} // {UNIT}, (q * {CUT} + {CUT - 1}) // {UNIT} + 1)) AS u FROM q), st AS (SELECT DISTINCT id, u AS b FROM u), "
        f"w AS (SELECT st.id, st.b FROM st JOIN st y ON y.id = st.id AND y.b >= st.b AND y.b < st.b + {LENGTH} GROUP BY ALL HAVING count(*) = {LENGTH}), "
        f"p AS (SELECT DISTINCT w.id, w.b, q.q, CAST(q.w AS DOUBLE) AS w, sm, mn, mx, (q.q * {CUT} + {CUT} / 2.0) / {UNIT} - w.b AS m, {CUT / 2 / UNIT} AS h, "
        f"q.q * {CUT} < w.b * {UNIT} AS left_, (q.q + 1) * {CUT} > (w.b + {LENGTH}) * {UNIT} AS right_ FROM w JOIN q ON q.id = w.id AND (q.q + 1) * {CUT} > w.b * {UNIT} AND q.q * {CUT} < (w.b + {LENGTH}) * {UNIT})"
        f"{part}, v AS (SELECT id, b, min(lo) AS lo, max(hi) AS hi, max(CASE WHEN k = 0 THEN est END) AS est FROM ({every}) GROUP BY ALL), "
        "i AS (SELECT id, b, degrees(atan(coalesce(est, (lo + hi) / 2))) AS est, degrees(atan(lo)) AS lo, degrees(atan(hi)) AS hi, lo IS NOT NULL AS defined FROM w LEFT JOIN v USING (id, b))"
    )


@query(f"{_straddling_sql()} SELECT id, b, round(est, 4) AS est, round(lo, 4) AS lo, round(hi, 4) AS hi, defined FROM i")
def slope_interval_straddler(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slopes.straddling_interval(buckets.aggregate(series(spark, sf), CUT, ORIGIN), CUT, UNIT, LENGTH), 4)


@query()
def rigorous_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Exact slopes held against bounds that take all parts of cut sub-buckets into account."""
    bounds = slopes.rigorous_interval(buckets.aggregate(series(spark, sf), CUT, ORIGIN), CUT, UNIT, LENGTH)
    exact = slopes.runs(patterns.grid(series(spark, sf), UNIT, ORIGIN, N), LENGTH, LENGTH)
    inside = F.col("defined") & F.col("angle").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    return bounds.join(exact, ["id", "b"]).groupBy("id").agg(F.count("*").alias("windows"), F.count_if("defined").alias("defined"), F.count_if(inside).alias("inside"))


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slopes.bootstrap_ci(buckets.rank_sample(series(spark, sf), DAY, ORIGIN, 0, 40), DAY, ORIGIN))


@query(f"{base._interval()} SELECT id, count(*) AS windows, round(avg(CASE WHEN defined THEN (hi - lo) / 180 ELSE 1.0 END), 6) AS error FROM i GROUP BY id")
def unit_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(slopes.unit_error(base._bounds(spark, sf)))


TWO = patterns.parse(f"{LENGTH}:20:80;{LENGTH}:-80:-20")


def _o(low: float, high: float) -> str:
    return f"CASE WHEN NOT defined THEN 1.0 WHEN hi > lo THEN least(1.0, (greatest(0.0, {low} - lo) + greatest(0.0, hi - {high})) / (hi - lo)) ELSE 0.0 END"


@query(
    f"{base._interval()}, x AS (SELECT id, b, {_o(20, 80)} AS o, defined FROM i WHERE NOT defined OR hi >= 20 AND lo <= 80), y AS (SELECT id, b, {_o(-80, -20)} AS o, defined FROM i WHERE NOT defined OR hi >= -80 AND lo <= -20) "
    f"SELECT x.id, x.b, x.b + {2 * LENGTH} AS z, round(1 - (1 - x.o) * (1 - y.o), 6) AS overshoot, x.defined AND y.defined AND 1 - (1 - x.o) * (1 - y.o) <= 0.5 AS confident FROM x JOIN y ON y.id = x.id AND y.b = x.b + {LENGTH}"
)
def pattern_relaxed_two_seg(spark: SparkSession, sf: str) -> DataFrame:
    sub = buckets.aggregate(series(spark, sf), UNIT // base.FACTOR, ORIGIN)
    return rounded(patterns.relaxed(sub, base.FACTOR, TWO, 0.5).select("id", "b", F.col("to").alias("z"), "overshoot", "confident"))


UPWARD = "2-3:10:89"


@query(
    f"{base.OLS}, {base._runs(2, 3)}, f AS (SELECT id, b, b + len AS z FROM r WHERE angle BETWEEN 10 AND 89), w AS (SELECT id, b, z FROM f UNION SELECT w.id, w.b, f.z FROM w JOIN f ON f.id = w.id AND f.b = w.z) "
    "SELECT id, b, max(z) AS z FROM w GROUP BY ALL".replace("WITH ", "WITH RECURSIVE ", 1)
)
def pattern_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """The longest chain of rises at each start."""
    grid = patterns.grid(series(spark, sf), UNIT, ORIGIN, N)
    return patterns.regex_matches(grid, patterns.parse(f"{UPWARD}+"), N).select("id", "b", F.col("to").alias("z"))


NESTED = (patterns.Group((patterns.parse("2:10:89")[0], patterns.Group(tuple(patterns.parse("2:-89:-10")), 0, 1)), 1, 2),)
_nested = [base._matches(c).replace("WITH ", "", 1) for c in patterns.sequences(NESTED, N)]


@query(" UNION ".join(f"SELECT * FROM (WITH {x} {base.OUT} FROM m)" for x in _nested))
def pattern_nested_group(spark: SparkSession, sf: str) -> DataFrame:
    grid = patterns.grid(series(spark, sf), UNIT, ORIGIN, N)
    return base._out(patterns.alternatives(grid, patterns.sequences(NESTED, N), N))


ALL_SIZES = [(shape, size) for shape in patterns.SHAPES for size in patterns.SIZES]


@query(" UNION ALL ".join(f"SELECT * FROM ({base._matches(patterns.predefined(*p))} SELECT '{p[0]}_{p[1]}' AS name, count(*) AS matches FROM m)" for p in ALL_SIZES))
def predefined_sizes(spark: SparkSession, sf: str) -> DataFrame:
    grid = workspace.written(patterns.grid(series(spark, sf), UNIT, ORIGIN, N), "grid")
    out = None
    for shape, size in ALL_SIZES:
        t = patterns.matches(grid, patterns.predefined(shape, size), N).agg(F.lit(f"{shape}_{size}").alias("name"), F.count("*").alias("matches"))
        out = t if out is None else out.unionByName(t)
    return out


# The engine

SAMPLING = 5 * MINUTE


def _engine(spark: SparkSession, sf: str, **options) -> engine.Engine:
    return engine.Engine(series(spark, sf), SAMPLING, ORIGIN, END, **options)


def _done(e: engine.Engine, rows: DataFrame) -> DataFrame:
    """The rows, written, once the engine's tables are given back."""
    out = workspace.written(rows, "result")
    e.close()
    return out


@query(f"SELECT DISTINCT id, CAST(b AS INTEGER) AS px, ts_ms, value FROM (SELECT id, b, unnest([first_ms, min_ms, max_ms, last_ms]) AS ts_ms, unnest([first_v, min_v, max_v, last_v]) AS value FROM ({base._four(STEP)}) WHERE b >= 0 AND b < {WIDTH} AND id IN ('click', 'view'))")
def view_accuracy_one(spark: SparkSession, sf: str) -> DataFrame:
    """A view at accuracy 1, after the cache has answered another: the same as reading it exactly."""
    e = _engine(spark, sf)
    e.execute(engine.View(ORIGIN, END, ("click",), WIDTH, HEIGHT, 0.5))
    return _done(e, e.execute(engine.View(ORIGIN, END, ("click", "view"), WIDTH, HEIGHT, 1.0)).rows)


@query()
def visual_scoped_accuracy95(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    return _done(e, e.execute(engine.View(ORIGIN, END, ("click", "error"), WIDTH, HEIGHT, 0.95)).rows)


@query()
def visual_full_accuracy95(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf, scoped=False)
    return _done(e, e.execute(engine.View(ORIGIN, END, ("click", "error"), WIDTH, HEIGHT, 0.95)).rows)


@query(f"SELECT id, b + {ORIGIN // UNIT} AS b, z + {ORIGIN // UNIT} AS z, lens FROM ({base._greedy_sql(base.UP_DOWN, 'DESC')}) WHERE id = 'click'")
def pattern_engine_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern at accuracy 1 over a range on the grid of its unit."""
    e = _engine(spark, sf)
    rows = e.execute(engine.PatternQuery(ORIGIN, END, "click", UNIT, tuple(base.UP_DOWN), 1.0)).rows
    return _done(e, rows.select("id", "b", F.col("to").alias("z"), "lens"))


@query()
def pattern_engine_refined(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern at accuracy 0.9: bounds first, finer ones where they leave doubt, exact slopes at the end."""
    e = _engine(spark, sf)
    return _done(e, e.execute(engine.PatternQuery(ORIGIN, END, "click", UNIT, tuple(base.UP_DOWN), 0.9)).rows)


SESSION = [(0, 30, 0.9), (3, 23, 0.9), (0, 30, 0.5)]


@query()
def engine_session(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of views one after the other; the later ones find their groups kept. No times, which differ from run to run."""
    e = _engine(spark, sf)
    results = [e.execute(engine.View(ORIGIN + a * DAY, ORIGIN + z * DAY, ("click",), WIDTH, HEIGHT, acc)) for a, z, acc in SESSION]
    rows = [r | {"width": WIDTH, "height": HEIGHT, "init_seconds": 0.0, "seconds": 0.0} for r in engine.metrics_rows(results)]
    e.close()
    return rounded(catalog.metrics_frame(spark, rows, dataset="events"))


HALF = ORIGIN + 13 * HOUR


@query(f"WITH {S} SELECT id, {b(UNIT)} AS b, {base.AGG} FROM s WHERE id = 'click' AND ts_ms >= {ORIGIN} AND ts_ms < {ORIGIN + 2 * DAY} GROUP BY ALL")
def cached_cut_span(spark: SparkSession, sf: str) -> DataFrame:
    """A kept span of 13 hours answers three buckets of four hours; the fourth is read anew."""
    cache = coverage.Cache(series(spark, sf), ORIGIN)
    cache.aggregate("click", ORIGIN, HALF, HOUR)
    out = workspace.written(cache.aggregate("click", ORIGIN, ORIGIN + 2 * DAY, UNIT).withColumn("sm", F.round("sm", 6)), "result")
    cache.close()
    return out


QUARTER = 15 * MINUTE


@query(f"WITH {S} SELECT id, CAST(width AS BIGINT) AS width, width <> {QUARTER} AS kept FROM (SELECT DISTINCT id FROM s), (SELECT unnest([{QUARTER}, {HOUR}, {8 * HOUR}, {DAY}]) AS width)")
def eviction_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Of spans of four widths near a request for four hours, the one that suits it least goes, which is enough."""
    rows = []
    for r in src.metadata(series(spark, sf)).orderBy("id").collect():  # a row for each measure
        low = r["first_ms"] // DAY * DAY
        spans = [coverage.Span(r["id"], w, low, low + 4 * DAY) for w in (QUARTER, HOUR, 8 * HOUR, DAY)]
        recent = [(r["id"], low, low + DAY, 4 * HOUR)]
        gone = {s for _, s in coverage.evictions(spans, recent, int(sum(s.bytes for s in spans) / 0.85))}
        rows += [(r["id"], s.width, s not in gone) for s in spans]
    return spark.createDataFrame(rows, "id string, width bigint, kept boolean")


@query(f"WITH {S}, r AS (SELECT id, (min(ts_ms) - {ORIGIN}) // {HOUR} AS a, (max(ts_ms) - {ORIGIN}) // {HOUR} + 1 AS z FROM s GROUP BY id) SELECT id, {ORIGIN} + greatest(a, a + (z - a) // 3 - 24) * {HOUR} AS low, {ORIGIN} + (a + (z - a) // 3) * {HOUR} AS high FROM r UNION ALL SELECT id, {ORIGIN} + (a + (z - a) // 3 + 48) * {HOUR}, {ORIGIN} + least(z, a + (z - a) // 3 + 72) * {HOUR} FROM r")
def prefetch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """What to fetch around a view of 48 hours that begins at a third of each measure's range."""
    rows = []
    for r in src.metadata(series(spark, sf)).collect():  # a row for each measure
        a, z = (r["first_ms"] - ORIGIN) // HOUR, (r["last_ms"] - ORIGIN) // HOUR + 1
        low = a + (z - a) // 3
        pairs = coverage.prefetch(low, low + 48, 1.0, a, z)
        rows += [(r["id"], ORIGIN + x * HOUR, ORIGIN + y * HOUR) for x, y in pairs]
    return spark.createDataFrame(rows, "id string, low bigint, high bigint")


SPANS = f"p AS (SELECT *, row_number() OVER (ORDER BY ts_ms, id) - 1 AS k FROM (SELECT DISTINCT epoch_us(ts) // 1000 AS ts_ms, event_type AS id, user_id FROM events WHERE event_type = 'click' ORDER BY 1 LIMIT 40)), sp AS (SELECT ts_ms // {HOUR} * {HOUR} AS low, [{HOUR}, {2 * HOUR}, {4 * HOUR}][CAST(k % 3 + 1 AS INTEGER)] AS width, ts_ms // {HOUR} * {HOUR} + {4 * HOUR} * (2 + user_id % 5) AS high FROM p)"


@query(
    f"WITH {SPANS}, t AS (SELECT unnest(range({ORIGIN}, {END}, {4 * HOUR})) AS b), o AS (SELECT t.b, sp.width, row_number() OVER (PARTITION BY t.b ORDER BY sp.width DESC, sp.low) AS r FROM t JOIN sp ON sp.low <= t.b AND sp.high >= t.b + {4 * HOUR}) "
    "SELECT t.b AS low, CAST(coalesce(o.width, 0) AS BIGINT) AS width FROM t LEFT JOIN o ON o.b = t.b AND o.r = 1"
)
def coverage_coarsest(spark: SparkSession, sf: str) -> DataFrame:
    """Which of forty spans, made of events, answers each bucket of four hours: the widest, then the earliest."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'")
    points = src.from_long(e, "ts", "event_type", "value").select("ts_ms").join(e.select(F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts_ms"), "user_id"), "ts_ms")
    rows = points.distinct().orderBy("ts_ms").limit(40).collect()
    spans = []
    for k, r in enumerate(rows):
        low = r["ts_ms"] // HOUR * HOUR
        spans.append(coverage.Span("click", (HOUR, 2 * HOUR, 4 * HOUR)[k % 3], low, low + 4 * HOUR * (2 + r["user_id"] % 5)))
    taken, missing = coverage.coverage(spans, "click", ORIGIN, END, 4 * HOUR)
    pieces = [(s.width, a, z) for s, a, z in taken] + [(0, a, z) for a, z in missing]
    return spark.createDataFrame([(b_, w) for w, a, z in pieces for b_ in range(a, z, 4 * HOUR)], "low bigint, width bigint")


@query(
    f"WITH {S}, h AS (SELECT id, ts_ms // {HOUR} * {HOUR} AS low, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3), i AS (SELECT *, CASE WHEN low - lag(low) OVER (PARTITION BY id ORDER BY low) - {HOUR} <= {2 * HOUR} THEN 0 ELSE 1 END AS new FROM h), "
    f"j AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY low) AS k FROM i) SELECT id, min(low) AS low, max(low) + {HOUR} AS high FROM j GROUP BY id, k"
)
def group_intervals_demo(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with three points or more, merged over gaps of two hours."""
    t = buckets.aggregate(series(spark, sf), HOUR, 0).where("n >= 3").groupBy("id").agg(F.collect_list("b").alias("b"))  # hours of a month
    rows = [(r["id"], *p) for r in t.collect() for p in timeunits.group_intervals([(x * HOUR, x * HOUR + HOUR) for x in r["b"]], 2 * HOUR)]
    return spark.createDataFrame(rows, "id string, low bigint, high bigint")


LADDER = "l AS (SELECT DISTINCT u * k AS w FROM (SELECT u, n, unnest(range(1, n)) AS k FROM (VALUES (1, 1000), (1000, 60), (60000, 60), (3600000, 24)) t(u, n)) WHERE n % k = 0 UNION SELECT 86400000)"


@query(f"WITH {S}, {LADDER}, g AS (SELECT DISTINCT least(ts_ms % 100000007, 90000000) AS width FROM s WHERE id = 'click') SELECT width, CAST(coalesce((SELECT max(w) FROM l WHERE w <= width), 1) AS BIGINT) AS down, CAST(coalesce((SELECT min(w) FROM l WHERE w >= width), 86400000) AS BIGINT) AS up FROM g")
def calendar_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Widths made of events, and the ladder's below and above."""
    rows = series(spark, sf).where("id = 'click'").select(F.least(F.col("ts_ms") % 100000007, F.lit(90000000)).alias("w")).distinct().collect()
    return spark.createDataFrame([(r["w"], timeunits.snap_down(r["w"]), timeunits.snap_up(r["w"])) for r in rows], "width bigint, down bigint, up bigint")


# Time


@query(f"WITH {S} SELECT id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS said, ts_ms AS back FROM s")
def text_times(spark: SparkSession, sf: str) -> DataFrame:
    t = series(spark, sf).select("id", timeunits.to_text(F.col("ts_ms")).alias("said"))
    return t.select("id", "said", timeunits.from_text(F.col("said")).alias("back"))


@query(f"WITH {S} SELECT id, ts_ms, epoch_ms(date_trunc('day', t) + to_hours(CAST(hour(t) // 5 * 5 AS INTEGER))) AS fives, epoch_ms(date_trunc('month', t) + to_days(CAST((day(t) - 1) // 7 * 7 AS INTEGER))) AS weeks, epoch_ms(date_trunc('hour', t)) AS hours FROM (SELECT *, make_timestamp(ts_ms * 1000) AS t FROM s)")
def calendar_buckets(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts_ms")
    names = {"fives": (5, "hour"), "weeks": (7, "day"), "hours": (1, "hour")}
    return series(spark, sf).select("id", "ts_ms", *(timeunits.calendar_bucket(at, k, u).alias(c) for c, (k, u) in names.items()))


@query(f"WITH {S}, r AS (SELECT id, min(ts_ms) AS a, max(ts_ms) AS z FROM s GROUP BY id) SELECT id, a // {DAY} * {DAY} + a % {DAY} // {5 * HOUR} * {5 * HOUR} AS low, CASE WHEN z % {DAY} % {5 * HOUR} = 0 THEN z ELSE least(z // {DAY} * {DAY} + (z % {DAY} // {5 * HOUR} + 1) * {5 * HOUR}, (z // {DAY} + 1) * {DAY}) END AS high FROM r")
def day_aligned_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(r["id"], *timeunits.day_align(r["first_ms"], r["last_ms"], 5, HOUR)) for r in src.metadata(series(spark, sf)).collect()]
    return spark.createDataFrame(rows, "id string, low bigint, high bigint")


# Sources and sinks


@query(f"WITH {S}, r AS (SELECT id, ts_ms, dense_rank() OVER (PARTITION BY id ORDER BY ts_ms) AS k FROM s) SELECT id, max(CASE WHEN k = 2 THEN ts_ms END) - max(CASE WHEN k = 1 THEN ts_ms END) AS sampling FROM r WHERE k <= 2 GROUP BY id")
def dataset_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.sampling(series(spark, sf))


@query(f"WITH {S} SELECT ts_ms, id, value FROM s WHERE id IN ('click', 'view') AND ts_ms >= {ORIGIN} AND ts_ms < {ORIGIN + 3 * DAY} ORDER BY ts_ms, id")
def ordered_scan(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.raw(series(spark, sf), ["click", "view"], ORIGIN, ORIGIN + 3 * DAY)


@query(f"WITH {S} SELECT id, count(DISTINCT ts_ms) AS times, count(DISTINCT value) AS vals FROM s GROUP BY id")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).groupBy("id").agg(F.count_distinct("ts_ms").alias("times"), F.count_distinct("value").alias("vals"))


@query(f"SELECT id, b, n AS count, first_v AS first, max_v AS max FROM ({base._four(UNIT)})")
def bucket_functions(spark: SparkSession, sf: str) -> DataFrame:
    return buckets.aggregate_of(series(spark, sf), UNIT, ORIGIN, ("count", "first", "max"))


@query(f"WITH {S}, p AS (SELECT ts_ms, id, value FROM s WHERE ts_ms < {ORIGIN + 5 * DAY}) SELECT ts_ms AS timestamp, min(CASE WHEN id = 'click' THEN value END) AS click, min(CASE WHEN id = 'view' THEN value END) AS view FROM p WHERE id IN ('click', 'view') GROUP BY ts_ms")
def sink_wide_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A wide CSV of two measures, read back."""
    path = workspace.fresh(spark, "csv")
    catalog.to_csv(coverage.raw(series(spark, sf), ["click", "view"], ORIGIN, ORIGIN + 5 * DAY), ["click", "view"], path)
    return spark.read.option("header", True).schema("timestamp bigint, click double, view double").csv(path)


@query(f"WITH {S} SELECT ts_ms, id, value FROM s")
def wide_csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """All points of all measures written as a wide CSV with times as text, and read as a series."""
    path = workspace.fresh(spark, "csv")
    points = series(spark, sf)
    ids = [r["id"] for r in points.select("id").distinct().orderBy("id").collect()]
    table = catalog.wide_rows(points, ids).withColumn("timestamp", timeunits.to_text(F.col("timestamp")))
    table.write.option("header", True).csv(path)
    return src.from_csv(spark, path, "timestamp", ids, "yyyy-MM-dd HH:mm:ss.SSS").select("ts_ms", "id", "value")


@query(f"WITH {S} SELECT ts_ms, id, value FROM s WHERE id = 'click' AND ts_ms < {ORIGIN + 5 * DAY}")
def jdbc_source(spark: SparkSession, sf: str) -> DataFrame:
    """A table written to the database that comes with Spark, and a range of it read back."""
    url = catalog.to_derby(src.within(series(spark, sf), ORIGIN, ORIGIN + 6 * DAY), "points", createTableColumnTypes="id VARCHAR(64)")
    points = catalog.from_jdbc(spark, url, "points", driver=catalog.DERBY)
    return workspace.written(src.scan(points, {"click": [src.Interval(ORIGIN, ORIGIN + 5 * DAY)]}), "points")


@query(f"{base._greedy_sql(base.UP_DOWN, 'DESC').replace(base.OUT, 'SELECT *')}".replace(" SELECT * FROM w", f" SELECT id || ' ' || (b * {UNIT} + {ORIGIN}) || '..' || (z * {UNIT} + {ORIGIN}) || ' [' || (b * {UNIT} + {ORIGIN}) || '..' || ((b + 6) * {UNIT} + {ORIGIN}) || ', ' || ((b + 6) * {UNIT} + {ORIGIN}) || '..' || (z * {UNIT} + {ORIGIN}) || ']' AS value FROM w"))
def sink_match_log(spark: SparkSession, sf: str) -> DataFrame:
    """Matches as lines of text, read back."""
    path = workspace.fresh(spark, "log")
    found = patterns.without_overlap(patterns.select(base._found(spark, sf, base.UP_DOWN)))
    catalog.to_match_log(found, UNIT, path, ORIGIN)
    return spark.read.text(path)


@query(f"{base._interval()} SELECT CAST(7 AS BIGINT) AS query, CAST({base.FACTOR} AS BIGINT) AS factor, id, b, b * {UNIT} + {ORIGIN} AS low, (b + {LENGTH}) * {UNIT} + {ORIGIN} AS high, round(lo, 4) AS min_angle, round(hi, 4) AS max_angle, round(hi - lo, 4) AS width, NOT defined AS undefined FROM i")
def sink_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Slope bounds written as CSV, read back."""
    path = workspace.fresh(spark, "bounds")
    catalog.to_bounds_csv(base._bounds(spark, sf), path, 7, base.FACTOR, UNIT, LENGTH, ORIGIN)
    kinds = "query bigint, factor bigint, id string, b bigint, low bigint, high bigint, min_angle double, max_angle double, width double, undefined boolean"
    return rounded(spark.read.option("header", True).schema(kinds).csv(path), 4)


# Workloads and scores

LINE = "ts_ms || ',' || (ts_ms + 3600000 * (1 + user_id % 5)) || ',a,b,' || (user_id % 3) || '|' || (user_id % 7) || ',' || (100 + user_id % 50) || ',60,0.9,' || CASE WHEN user_id % 2 = 0 THEN 'visual,pan' ELSE 'pattern,custom,' || (1 + user_id % 4) || ' Hours,6:20:89' END"


@query("WITH e AS (SELECT epoch_us(ts) // 1000 AS ts_ms, user_id FROM events) SELECT ts_ms AS low, ts_ms + 3600000 * (1 + user_id % 5) AS high, ['x', 'y', 'z'][CAST(user_id % 3 + 1 AS INTEGER)] || '+' || CASE WHEN user_id % 7 < 3 THEN ['x', 'y', 'z'][CAST(user_id % 7 + 1 AS INTEGER)] ELSE CAST(user_id % 7 AS VARCHAR) END AS measures, CAST(100 + user_id % 50 AS INTEGER) AS width, 60 AS height, CAST(0.9 AS DOUBLE) AS accuracy, CASE WHEN user_id % 2 = 0 THEN 'visual' ELSE 'pattern' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'pan' ELSE 'custom' END AS name, CASE WHEN user_id % 2 = 1 THEN 3600000 * (1 + user_id % 4) ELSE 0 END AS unit, CASE WHEN user_id % 2 = 1 THEN '6:20:89' END AS segments FROM e")
def workload_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Trace lines made of events, and one broken line, parsed."""
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("unix_micros(cast(ts AS timestamp)) div 1000 AS ts_ms", "user_id")
    lines = e.selectExpr(f"{LINE} AS value").unionByName(spark.createDataFrame([("broken,line",)], "value string"))
    return workload.parse(lines, ("x", "y", "z")).withColumns({"measures": F.array_join("measures", "+"), "unit": F.coalesce("unit", F.lit(0))})


@query(
    f"{base._interval()}, {base.O}, {base._runs(LENGTH, LENGTH)}, t AS (SELECT id, b FROM r WHERE angle BETWEEN 20 AND 80), {base.CLASSED}, f AS (SELECT id, b FROM c WHERE o <= 0.5), i2 AS (SELECT id FROM t UNION SELECT id FROM f) "
    "SELECT i2.id, (SELECT count(*) FROM t JOIN f USING (id, b) WHERE id = i2.id) AS tp, (SELECT count(*) FROM f ANTI JOIN t USING (id, b) WHERE id = i2.id) AS fp, (SELECT count(*) FROM t ANTI JOIN f USING (id, b) WHERE id = i2.id) AS fn FROM i2"
)
def match_scoring_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that the bounds are sure of held against the exact ones, without tolerance."""
    truth = base._found(spark, sf, patterns.parse(f"{LENGTH}:20:80"))
    sure = patterns.classified(base._bounds(spark, sf), 20, 80, 0.5).where("confident").select("id", "b", (F.col("b") + LENGTH).alias("to"))
    return scoring.match_scores(truth, sure, 0)


SCORES = "c AS (SELECT event_type AS method, event_id AS query, user_id % 7 AS tp, user_id % 3 AS fp, user_id % 4 AS fn, 0.2 AS slack, 'axis' || (user_id % 2) AS axis, 'cohort' || (user_id % 5) AS cohort, value AS seconds, user_id % 5 AS run FROM events)"
PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Counts made of events, as if each were a query."""
    e, u = spark.read.parquet(f"{sf}/events.parquet"), F.col("user_id")
    made = {"tp": u % 7, "fp": u % 3, "fn": u % 4, "slack": F.lit(0.2), "axis": F.concat(F.lit("axis"), u % 2), "cohort": F.concat(F.lit("cohort"), u % 5)}
    return e.select(F.col("event_type").alias("method"), F.col("event_id").alias("query"), *(c.alias(k) for k, c in made.items()), F.col("value").alias("seconds"), (u % 5).alias("run"))


@query(
    f"WITH {SCORES}, e AS (SELECT *, {PRF} FROM c), m AS (SELECT method, count(*) AS queries, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f) AS macro_f1, avg(CASE WHEN p >= 0.8 THEN 1.0 WHEN p < 0.8 THEN 0.0 END) AS pass_rate, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM e GROUP BY method), "
    f"n AS (SELECT *, {PRF} FROM m) SELECT method, queries, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(f, 6) AS micro_f1, round(pass_rate, 6) AS pass_rate FROM n"
)
def accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.accuracy_summary(_scores(spark, sf)))


@query(
    f"WITH {SCORES}, e AS (SELECT *, {PRF} FROM c), m AS (SELECT axis, cohort, count(*) AS queries, avg(p) AS mean_precision, avg(r) AS mean_recall, avg(f) AS macro_f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(seconds) AS mean_seconds FROM e GROUP BY ALL) "
    "SELECT axis, cohort, queries, round(mean_precision, 6) AS mean_precision, round(mean_recall, 6) AS mean_recall, round(macro_f1, 6) AS macro_f1, tp, fp, fn, round(mean_seconds, 6) AS mean_seconds, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM m"
)
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.cohort_summary(_scores(spark, sf)))


@query("SELECT event_type AS method, count(*) AS queries, round(avg(value), 6) AS mean_ssim, round(median(value), 6) AS median_ssim, round(avg(user_id), 6) AS mean_different, round(median(user_id), 6) AS median_different FROM events GROUP BY ALL")
def view_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(scoring.view_summary(e.select(F.col("event_type").alias("method"), F.col("value").alias("ssim"), F.col("user_id").cast("double").alias("different"))))


@query(f"WITH {SCORES}, r AS (SELECT axis AS dataset, method, run, sum(seconds) AS s FROM c GROUP BY ALL), z AS (SELECT axis AS dataset, count(*) AS rows FROM c GROUP BY ALL) SELECT dataset, rows, method, round(avg(s), 4) AS total FROM r JOIN z USING (dataset) GROUP BY ALL")
def scalability(spark: SparkSession, sf: str) -> DataFrame:
    costs = _scores(spark, sf).withColumnRenamed("axis", "dataset")
    return rounded(scoring.scalability(costs, costs.groupBy("dataset").agg(F.count("*").alias("rows"))), 4)


@query("WITH c AS (SELECT event_id AS query, event_type AS subset, value AS seconds FROM events), s AS (SELECT query, subset, row_number() OVER (PARTITION BY subset ORDER BY query) - 1 AS place FROM c) SELECT 'whole' AS method, CAST(1 AS BIGINT) AS run, s.query, s.subset, c.seconds FROM s JOIN c USING (query)")
def trace_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of a trace's parts, each numbered by itself, put back in the order of the whole."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("query"), F.col("event_type").alias("kind"), F.col("value").alias("seconds"))
    split = scoring.split_trace(e)
    parts = split.join(e, "query").select("subset", "place", F.lit(1).cast("long").alias("run"), "seconds")
    return scoring.merged_trace(parts, split, "whole")
