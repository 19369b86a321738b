import itertools
import math
import os
import random
import subprocess
import sys
import time
from datetime import timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidemark import registry, registry_engine  # noqa: F401
from tidemark.functions import timeunits
from tidemark.operators import buckets, patterns, pixels, slopes
from tidemark.plans import scoring, workload
from tidemark.plans.coverage import Cache, Span, coverage, evictions, view_coverage
from tidemark.plans.engine import Engine, PatternQuery, View, run
from tidemark.sources import catalog, series
from tidemark.streaming import rollup

SF = "/root/testdata/sf0.001"


def rows(df):
    clean = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


NAMES = """
dataset_metadata m4_timestamps rollup_m4 rollup_minmax rollup_ols hash_rank_sample bucket_mean_dense pattern_exact_two_seg pattern_var_length
pattern_unbounded pattern_nested_group pattern_relaxed_two_seg pixel_diff pixel_error_columns high_error_intervals cached_equals_exact cached_cut_span missing_intervals
coverage_coarsest row_pattern_sql ambiguous_regions slope_interval slope_interval_straddler pattern_cached_equals_exact pattern_engine_exact
view_accuracy_one cache_hit_ratio prefetch_ranges method_cost_summary accuracy_summary risk_coverage shape_detector workload_parse stream_rollup
calendar_snap calendar_buckets sink_match_log sink_wide_csv
""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_vertex_bounds_hold_the_true_slope(spark):
    rng, data, true = random.Random(3), [], {}
    for k in range(40):
        pts = [(k, i + rng.random(), lo := 5 * rng.gauss(0, 1), lo + 3 * rng.random()) for i in range(rng.randint(3, 20))]
        data += pts
        ys = [rng.uniform(a, z) for _, _, a, z in pts]
        xm, ym = sum(p[1] for p in pts) / len(pts), sum(ys) / len(ys)
        true[k] = sum((p[1] - xm) * (y - ym) for p, y in zip(pts, ys)) / sum((p[1] - xm) ** 2 for p in pts)
    got = slopes.vertex_bounds(spark.createDataFrame(data, "k int, x double, y_min double, y_max double"), "k").collect()
    assert len(got) == 40 and all(r["lo"] - 1e-9 <= true[r["k"]] <= r["hi"] + 1e-9 for r in got)


def test_vertex_bounds_undefined(spark):
    assert slopes.vertex_bounds(spark.createDataFrame([(1, 2.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0), (2, 1.0, 0.0, 3.0)], "k int, x double, y_min double, y_max double"), "k").count() == 0


def test_bounds_hold_every_exact_slope(spark):
    r = registry.QUERIES["bound_validation"](spark, "/root/testdata/sf0.01").collect()
    assert sum(x["windows"] for x in r) == 875 and all(x["windows"] >= x["defined"] == x["inside"] for x in r)


def test_relaxed_search_loses_no_exact_match(spark):
    sf = "/root/testdata/sf0.01"
    exact = registry._found(spark, sf, patterns.parse("6:20:80")).select("id", "b").distinct()
    found = patterns.classified(registry._bounds(spark, sf), 20, 80, 0.95).select("id", "b")
    assert exact.count() == 375 and exact.join(found, ["id", "b"], "left_anti").count() == 0


def test_bounds_of_all_parts_hold_every_exact_slope(spark):
    r = registry_engine.rigorous_bounds(spark, "/root/testdata/sf0.001").collect()
    assert sum(x["defined"] for x in r) > 0 and all(x["defined"] == x["inside"] for x in r)


def test_bounds_of_a_straddled_segment():
    # Segment 0..20 on the line 4x: the first part begins before it, with one of its four points inside at most.
    parts = np.array([(-4, 4, 4, 48.0, 4.0, 16.0), (4, 8, 3, 72.0, 20.0, 28.0), (12, 16, 3, 168.0, 52.0, 60.0)])
    est, lo, hi = slopes.rigorous_bounds(parts / np.array([20, 20, 1, 1, 1, 1]), 1.0)
    assert lo is None or lo <= 80 <= hi


def bounds_by_trying(parts, end):
    outer = [i for i, there in ((0, parts[0][0] < 0), (len(parts) - 1, len(parts) > 1 and parts[-1][1] > end)) if there]
    lows, highs = [], []
    for k in itertools.product(*(range(int(parts[i][2]) + 1) for i in outer)):
        rows = [(f, t, w, sm / w, sm / w, mn, mx) for i, (f, t, w, sm, mn, mx) in enumerate(parts) if i not in outer]
        for i, c in zip(outer, k):
            f, t, w, sm, mn, mx = parts[i]
            if c:
                rows.append((max(f, 0), min(t, end), c, max(c * mn, sm - (w - c) * mx) / c, min(c * mx, sm - (w - c) * mn) / c, mn, mx))
        if len(rows) < 2:
            continue
        f, t, w, y0, y1, mn, mx = np.array(rows).T
        mid, half, n = (f + t) / 2, (t - f) / 2, w.sum()
        dx = mid - w @ mid / n
        down, up = w @ dx**2 - 2 * w @ (abs(dx) * half), w @ dx**2 + 2 * w @ (abs(dx) * half) + w @ ((half + w @ half / n) ** 2 + half**2)
        if down <= 1e-12 * up:
            return None
        e = w @ (half * (np.maximum(abs(y1 - w @ y0 / n), abs(y0 - w @ y1 / n)) + 2 * np.maximum(mx - y0, y1 - mn)))
        s0, s1 = np.minimum(w * dx * y0, w * dx * y1).sum() - e, np.maximum(w * dx * y0, w * dx * y1).sum() + e
        lows.append(min(s0 / down, s0 / up))
        highs.append(max(s1 / down, s1 / up))
    return (min(lows), max(highs)) if lows else None


def cut_parts(rng, k, off, points):
    ys = [rng.normal(3 * i, 1, points()) for i in range(k)]
    return np.array([(i * 0.4 - off, i * 0.4 + 0.4 - off, len(y), y.sum(), y.min(), y.max()) for i, y in enumerate(ys)])


@pytest.mark.parametrize("one_by_one", [1, 1 << 12])
def test_bounds_of_cut_parts_equal_those_by_trying(monkeypatch, one_by_one):
    monkeypatch.setattr(slopes, "PAIRS", one_by_one)
    monkeypatch.setattr(slopes, "CELL", 2)
    rng, defined = np.random.default_rng(5), 0
    for _ in range(60):
        k, off = int(rng.integers(2, 12)), rng.choice([0, 0.1, 0.3])
        parts = cut_parts(rng, k, off, lambda: rng.integers(1, 25))
        end = k * 0.4 - off - rng.choice([0, 0.1, 0.3])
        got, want = slopes.rigorous_bounds(parts, end)[1:], bounds_by_trying(parts.tolist(), end)
        defined += want is not None
        assert got == (None, None) if want is None else np.allclose(got, want, rtol=1e-9, atol=1e-9)
    assert defined > 20


def test_bounds_of_dense_cut_parts():
    # Nine million pairs of numbers of points inside.
    parts = cut_parts(np.random.default_rng(6), 13, 0.1, lambda: 3000)
    begun = time.monotonic()
    est, lo, hi = slopes.rigorous_bounds(parts, 4.9)
    assert lo < est < hi and time.monotonic() - begun < 20


def test_sketch_of_rising_parts(spark):
    rows = [("m", i, i / 2, i / 2 + 0.5, 1, i / 2 + 0.25) for i in range(4)]
    sub = spark.createDataFrame(rows, "id string, b bigint, mn double, mx double, n bigint, sm double")
    r = slopes.interval(sub, 4, 1).first()
    assert math.isclose(r["est"], math.degrees(math.atan(2)), rel_tol=1e-9)


def test_empty_parts_are_passed_over(spark):
    rows = [("m", b, 1.0 * b, 1.0 * b, 2, 2.0 * b) for b in (0, 3, 4, 7, 12, 15)]
    sub = spark.createDataFrame(rows, "id string, b bigint, mn double, mx double, n bigint, sm double")
    assert [r["b"] for r in slopes.interval(sub, 4, 2).orderBy("b").collect()] == [0]


def test_angles_far_from_the_origin(spark):
    far = 1_704_067_200_000
    s = spark.createDataFrame([(far + 1000 * i + d, "a", 2.0 * (i + d / 1000)) for i in range(60) for d in (0, 400, 900)], "ts_ms bigint, id string, value double")
    got = slopes.runs(buckets.regression_sums(s, 1000, 0), 2, 5).collect()
    assert len(got) == 59 + 58 + 57 + 56 and all(math.isclose(r["angle"], math.degrees(math.atan(2)), abs_tol=1e-4) for r in got)


def test_runs_reach_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(slopes, "BLOCK", 8)
    s = spark.createDataFrame([(10 * i + d, "a", math.sin(i) + d) for i in range(50) if i != 20 for d in (1, 7)], "ts_ms bigint, id string, value double")
    sums = buckets.regression_sums(s, 10, 0)
    got = {(r["b"], r["len"]) for r in slopes.runs(sums, 2, 4).collect()}
    assert got == {(b, k) for b in range(50) for k in (2, 3, 4) if b + k <= 50 and not b <= 20 < b + k}


def test_samples_have_their_interval(spark):
    line = [(1000 * i, "a", 3.0 * i) for i in range(60)]
    noisy = [(1000 * i, "b", 3.0 * i + random.Random(i).gauss(0, 5)) for i in range(60)]
    s = spark.createDataFrame([*line, *noisy, (0, "c", 1.0)], "ts_ms bigint, id string, value double")
    sums = buckets.regression_sums(s, 60_000, 0)
    ci = {r["id"]: r for r in slopes.sampled_ci(sums).collect()}
    true = math.degrees(math.atan(180))
    assert math.isclose(ci["a"]["lo"], ci["a"]["hi"], abs_tol=1e-3) and ci["b"]["lo"] <= true <= ci["b"]["hi"]
    one, two = (slopes.bootstrap_ci(buckets.rank_sample(s, 60_000, 0, 0, 100), 60_000, 0).orderBy("id").collect() for _ in range(2))
    boot = {r["id"]: r for r in one}
    assert one == two and boot["a"]["hi"] - boot["a"]["lo"] < 1e-6 and boot["b"]["lo"] < boot["b"]["est"] < boot["b"]["hi"]
    assert boot["c"]["est"] is None and (boot["c"]["lo"], boot["c"]["hi"]) == (-90, 90)


def test_gap_ends_a_segment(spark):
    s = spark.createDataFrame([(0, "a", 0.0), (5, "a", 1.0), (12, "a", 2.0), (31, "a", 5.0), (35, "a", 6.0)], "ts_ms bigint, id string, value double")
    got = patterns.matches(patterns.grid(s, 10, 0, 5), [patterns.Segment(2, 2, -90, 90)], 5).collect()
    assert [r["b"] for r in got] == [0]


def test_patterns_are_parsed():
    assert patterns.parse("6:*:*;2-3:10:80+;4:-5:5?;1:0:1{2,4}") == [
        patterns.Segment(6, 6), patterns.Segment(2, 3, 10, 80, 1, None), patterns.Segment(4, 4, -5, 5, 0, 1), patterns.Segment(1, 1, 0, 1, 2, 4)
    ]
    assert patterns.parse("1:*:**")[0].at_most is None and patterns.parse("1:*:*")[0].any
    for bad in ("0:1:2", "3-2:1:2", "1:20:10", "1:-100:0"):
        with pytest.raises(ValueError):
            patterns.parse(bad)


def test_groups_are_written_out():
    a, z = patterns.parse("2:10:89;3:-89:-10")
    group = patterns.Group((a, patterns.Group((z,), 0, 1)), 1, 2)
    assert sorted(map(len, patterns.sequences([group], 100))) == [1, 2, 2, 3, 3, 4]
    assert patterns.sequences([patterns.Segment(2, 2, 0, 1, 0, None)], 7) == [[patterns.Segment(2, 2, 0, 1)] * k for k in (1, 2, 3)]


@pytest.mark.parametrize("spec", ["2:0:1+", "2:0:1*;3:0:1", "1-2:0:1{2,3}", "2:0:1?;3:0:1?;1:0:1"])
def test_automaton_equals_written_out_sequences(spec):
    parts, last, rng = patterns.parse(spec), 14, random.Random(7)
    machine = patterns.Automaton(parts)
    fits = {(b, k): rng.random() < 0.6 for b in range(last) for k in (1, 2, 3)}
    starts = {b: [[k for k in range(s.shortest, s.longest + 1) if b + k <= last and fits[b, k]] for s in machine.segments] for b in range(last)}

    def ends(b, sequence):
        if not sequence:
            return {b}
        return {e for k in range(sequence[0].shortest, sequence[0].longest + 1) if b + k <= last and fits.get((b, k)) for e in ends(b + k, sequence[1:])}

    want = {b: {e for c in patterns.sequences(parts, last) for e in ends(b, c)} for b in range(last)}
    got = machine.ends(starts, last)
    assert {b: {e for e in range(last + 1) if x >> e & 1} for b, x in got.items()} == {b: x for b, x in want.items() if x}
    assert "digraph" in machine.dot()


def test_verified_matches(spark):
    kind = "id string, b bigint, to bigint, lens string"
    found = spark.createDataFrame([("a", 0, 2, "002"), ("a", 5, 8, "003")], kind)
    assert [r["exact"] for r in patterns.verified(found, found.limit(1)).orderBy("b").collect()] == [True, False]


def test_refinement_steps():
    assert [timeunits.next_factor(*x) for x in ((4, 0.1, 0.05), (4, 1, 0.01), (4, 0.04, 0.05), (4, 0.1, 0.05, 7), (1440, 0.3, 0.05, 1440), (4, 0.1, 0.05, -7))] == [8, 8, 4, None, None, 8]


def test_widths_and_days():
    assert timeunits.width_of("4 Hours") == 4 * timeunits.HOUR and timeunits.width_of("1 day") == timeunits.DAY
    hour, day = timeunits.HOUR, timeunits.DAY
    assert timeunits.day_align(day + 7 * hour, day + 10 * hour, 5, hour) == (day + 5 * hour, day + 10 * hour)
    assert timeunits.day_align(0, 10 * hour, 1, hour) == (0, 11 * hour) and timeunits.day_align(0, 23 * hour, 5, hour)[1] == day
    assert timeunits.buckets_between(0, 11, 5) == 3 and timeunits.divides(5, 15) and not timeunits.divides(10, 15)


def test_snapping_and_alignment():
    assert timeunits.snap_down(7 * timeunits.MINUTE) == 6 * timeunits.MINUTE and timeunits.snap_up(7 * timeunits.MINUTE) == 10 * timeunits.MINUTE
    assert timeunits.align(13, 47, 10) == (10, 50) and timeunits.align(10, 50, 10) == (10, 50)


def test_intervals():
    a, z = series.Interval(0, 10), series.Interval(10, 30)
    assert a.adjacent(z) and not a.overlaps(z) and a.span(z) == series.Interval(0, 30) and z.share(series.Interval(0, 15)) == 0.25


def test_only_the_widest_span_answers_a_view():
    hour, day = timeunits.HOUR, timeunits.DAY
    spans = [Span("m", w, 0, 40 * day) for w in (12 * hour, 6 * hour, 5 * timeunits.MINUTE)]
    taken, missing = view_coverage(spans, "m", 0, 40 * day, 4 * day)
    assert taken == [(spans[0], 0, 40 * day)] and not missing


def test_evictions():
    spans = [Span("a", 10, 0, 1000), Span("a", 10, 100_000, 101_000), Span("b", 10, 0, 1000)]
    recent = [("b", 0, 1000, 10), ("a", 0, 1000, 10)]
    assert evictions(spans, recent, 100_000) == []
    assert evictions(spans, recent, 11_000)[0] == ("roll up", spans[1])
    assert evictions([Span("a", 10, 100_005, 101_005)], recent, 1000)[0][0] == "drop"


def test_evicted_tables_are_given_back(spark):
    s = spark.createDataFrame([(i, m, float(i)) for i in range(100) for m in "ab"], "ts_ms bigint, id string, value double")
    with Cache(s, 0, budget=500) as cache:
        want = sorted(map(tuple, buckets.aggregate(s.where("id = 'a'"), 20, 0).collect()))
        for _ in range(2):
            assert sorted(map(tuple, cache.aggregate("a", 0, 100, 20).collect())) == want
            cache.aggregate("b", 0, 100, 10).count()
        assert cache.bytes <= 500 and cache.warm(["a"], 0, 100) >= 10
        with pytest.raises(ValueError):
            cache.aggregate("a", 5, 100, 20)
    assert not cache.tables


def test_measure_names_need_no_quoting(spark):
    s = spark.createDataFrame([(1, "o'clock", 1.0)], "ts_ms bigint, id string, value double")
    with Cache(s, 0) as cache:
        assert cache.aggregate("o'clock", 0, 10, 10).count() == 1


def test_queries_are_checked():
    for bad in (lambda: View(0, 1000, ("m",), 10, 10, 1.5), lambda: View(5, 5, ("m",)), lambda: View(0, 1000, ()), lambda: PatternQuery(0, 10, "m", 1, ())):
        with pytest.raises(ValueError):
            bad()


def test_engine_meets_its_accuracy(spark):
    rng = random.Random(1)
    s = spark.createDataFrame([(i * 100, "m", math.sin(i / 50) + rng.random() / 10) for i in range(4000)], "ts_ms bigint, id string, value double")
    e = Engine(s, 100, 0, 400_000)
    view = View(0, 400_000, ("m",), 40, 30, 0.9)
    first, again = e.execute(view), e.execute(view)
    assert first.errors["m"] <= 0.1 and again.metrics.hit_ratio == 1 and again.metrics.fetched_bytes == 0
    assert {r["px"] for r in first.rows.collect()} == set(range(40))
    raw, exact = run(e, view, "raw").rows, run(e, view, "aggregate").rows
    assert raw.count() == 4000 and exact.count() == e.execute(View(0, 400_000, ("m",), 40, 30, 1.0)).rows.count()
    ask = lambda accuracy: PatternQuery(0, 400_000, "m", 5000, tuple(patterns.parse("3-4:5:89;3-4:-89:-5")), accuracy)
    exact = {(r["b"], r["to"]) for r in e.execute(ask(1.0)).rows.collect()}
    near = e.execute(ask(0.99))
    assert exact and near.metrics.error_after <= 0.01 and exact <= {(r["b"], r["to"]) for r in near.rows.collect()} | exact
    e.close()
    assert not e.cache.tables


def test_hand_computed_pixel_error(spark):
    kind = "id string, f bigint, t bigint, n bigint, mn double, mn_ms bigint, mx double, mx_ms bigint"
    rows = [(0, 80, 5.0, 40, 6.0, 50), (80, 120, 5.0, 90, 5.0, 95), (120, 180, 3.0, 130, 5.0, 170), (180, 220, 0.0, 210, 8.0, 195), (220, 300, 5.0, 230, 6.0, 270)]
    groups = spark.createDataFrame([("m", f, t, 2, *x) for f, t, *x in rows], kind)
    judged = pixels.errors(pixels.columns(groups, 0, 300, 3), 10)
    r = {x["px"]: x for x in judged.collect()}
    assert [r[i]["error"] for i in range(3)] == [0, 0.7, 0.8] and r[1]["missing"] == [0, 1, 2]
    assert pixels.total_error(judged).first()["error"] == 0.5
    assert [tuple(x)[1:] for x in pixels.high_error(judged, 0.5).collect()] == [(100, 300)]
    groups = spark.createDataFrame([("m", f, t, 2, *x) for f, t, *x in [(0, 50, 2.0, 20, 4.0, 30), (50, 100, 1.0, 70, 3.0, 90), (100, 150, 5.0, 110, 7.0, 140), (150, 200, 3.0, 170, 6.0, 180)]], kind)
    assert 0 in next(x for x in pixels.errors(pixels.columns(groups, 0, 200, 2), 10).collect() if x["px"] == 1)["missing"]


def test_columns_that_cannot_be_told(spark):
    kind = "id string, f bigint, t bigint, n bigint, mn double, mn_ms bigint, mx double, mx_ms bigint"
    one = lambda *spans: pixels.columns(spark.createDataFrame([("m", f, t, 1, 1.0, f, 2.0, t - 1) for f, t in spans], kind), 0, 100, 1).first()["gapless"]
    assert one((10, 90)) and not one((0, 30), (60, 90)) and one((0, 50), (50, 90)) and not one((-10, 50))


def test_equal_rasters_are_alike(spark):
    a = spark.createDataFrame([("m", i, i % 7) for i in range(20)], "id string, px bigint, py int")
    assert math.isclose(pixels.similarity(a, a, 20, 10).first()["ssim"], 1.0)
    assert pixels.similarity(a, a.withColumn("py", a.py + 1), 20, 10).first()["ssim"] < 0.9


def test_metadata_store(spark, tmp_path):
    store = catalog.MetadataStore(str(tmp_path / "known.json"))
    s = spark.createDataFrame([(5, "b", 1.0), (10, "a", 1.0), (17, "a", 2.0), (30, "b", 1.0)], "ts_ms bigint, id string, value double")
    assert not store.has("x") and store.describe("x", s) == catalog.Metadata(("a", "b"), 5, 31, 7) == store.get("x") and store.get("x").measure(1) == "b"
    assert catalog.describe(s.limit(0)).header == () and catalog.describe(s, 3).sampling == 3


def test_confident_scores(spark):
    truth = spark.createDataFrame([("a", 0, 5), ("a", 10, 15)], "id string, b bigint, to bigint")
    found = spark.createDataFrame([("a", 1, 5, True), ("a", 10, 15, False), ("a", 30, 35, True)], "id string, b bigint, to bigint, confident boolean")
    assert tuple(scoring.confident_scores(truth, found, 1).first()) == ("a", 2, 1, 0, 1, 1)


def test_database_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("2024-01-01 00:00:00", "a", 1.5), ("2024-01-02 00:00:00", "b", 2.5)], "t string, id string, value double").selectExpr("cast(t AS timestamp) AS ts", "id", "value")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no database driver")
    catalog.to_jdbc(s, url, "points", driver="org.apache.derby.jdbc.EmbeddedDriver")
    for more in ({}, {"parts": 2, "low": "2024-01-01 00:00:00", "high": "2024-01-03 00:00:00"}):
        back = catalog.from_jdbc(spark, url, "points", driver="org.apache.derby.jdbc.EmbeddedDriver", **more)
        assert sorted((r["ts_ms"], r["id"], r["value"]) for r in back.collect()) == [(1704067200000, "a", 1.5), (1704153600000, "b", 2.5)]


def test_wide_csv_keeps_points_of_one_time(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.where("event_id % 3 = 0")).unionByName(events.where("event_id % 9 = 0").withColumn("value", -events.value)).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = rows(con.sql(registry.ORACLE_SQL["wide_csv_source"]).df())
    assert len(want) > len(set(want)) and rows(registry.QUERIES["wide_csv_source"](spark, str(tmp_path)).toPandas()) == want


def test_wide_csv_keeps_points_of_all_times(spark, tmp_path):
    """Also before the origin of the queries' grids and a year after it."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    shifted = [events.withColumn("ts", events.ts + timedelta(days)) for days in (-40, 365)]
    events.unionByName(shifted[0]).unionByName(shifted[1]).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = rows(con.sql("SELECT epoch_us(ts) // 1000 AS ts_ms, event_type AS id, value FROM events").df())
    assert len(want) == 3 * events.count() and rows(registry.QUERIES["wide_csv_source"](spark, str(tmp_path)).toPandas()) == want
    assert rows(con.sql(registry.ORACLE_SQL["wide_csv_source"]).df()) == want


def test_database_is_read_by_other_processes(tmp_path):
    """With executors of their own, which don't see the memory of the driver."""
    code = f"""
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.checkpoint.dir": "file://{tmp_path}", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
from tidemark import registry, registry_engine
registry.QUERIES["jdbc_source"](spark, "{SF}").toPandas().to_parquet("{tmp_path}/found.parquet")
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(Path(registry.__file__).parents[1])}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = rows(con.sql(registry.ORACLE_SQL["jdbc_source"]).df())
    assert want and rows(con.sql(f"SELECT * FROM '{tmp_path}/found.parquet'").df()) == want


def test_trace_runs_what_was_planted(spark):
    shapes = workload.planted(4000, 0, 1000, 500)
    lines = workload.walk(0, 4_000_000, 30, shapes)
    assert len(lines) == 30 and all(0 <= v.low < v.high <= 4_000_000 for v in lines) and lines == workload.walk(0, 4_000_000, 30, shapes)
    text = spark.createDataFrame([(x.text("0"),) for x in lines], "value string")
    asked = workload.queries(workload.parse(text, ("a", "b")))
    assert len(asked) == 30 and any(isinstance(q, PatternQuery) for q in asked) and all(getattr(q, "measure", "a") == "a" for q in asked)
    made = workload.cohorts(shapes, 0, 4_000_000, 2)
    assert set(made) >= {("length", "8seg"), ("width", "narrow"), ("selectivity", "few")} and all(len(v) <= 2 for v in made.values())


def test_coverage_prefers_the_widest():
    wide, narrow = Span("m", 20, 0, 100), Span("m", 10, 0, 200)
    assert coverage([narrow, wide], "m", 0, 220, 20) == ([(wide, 0, 100), (narrow, 100, 200)], [(200, 220)])


def test_overshoot(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(slopes.overshoot(F.lit(-10.0), F.lit(10.0), 0, 90).alias("a"), slopes.overshoot(F.lit(5.0), F.lit(5.0), 0, 1).alias("b")).first()
    assert math.isclose(r["a"], 0.5) and r["b"] == 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pattern_exact_two_seg"](spark, SF).columns == ["id", "b", "z", "lens", "a0"]


def test_match_scores_pair_one_to_one(spark):
    kind = "id string, b bigint, to bigint"
    truth = spark.createDataFrame([("a", 0, 5), ("a", 10, 15), ("a", 10, 15), ("b", 1, 2)], kind)
    found = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 30, 35), ("c", 1, 2)], kind)
    got = {r["id"]: tuple(r)[1:4] for r in scoring.precision_recall(scoring.match_scores(truth, found, 1)).collect()}
    assert got == {"a": (1, 2, 1), "b": (0, 0, 1), "c": (0, 1, 0)}


def test_rollup_follows_new_files_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "ts_ms bigint, id string, value double")
    inputs, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows((1, "a", 1.0), (12, "a", 4.0)).write.parquet(inputs)
    stream = lambda: spark.readStream.schema("ts_ms bigint, id string, value double").parquet(inputs)
    rollup.follow(stream(), 10, 0, path)
    rows((3, "a", -2.0)).write.mode("append").parquet(inputs)  # a late point
    rollup.follow(stream(), 10, 0, path)
    rollup.follow(stream(), 10, 0, path)
    got = sorted(tuple(r) for r in rollup.read(spark, path).select("id", "b", "mn", "mx", "n", "sm").collect())
    assert got == [("a", 0, -2.0, 1.0, 2, -1.0), ("a", 1, 4.0, 4.0, 1, 4.0)]
