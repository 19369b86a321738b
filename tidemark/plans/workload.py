"""Query traces: reading their lines, and making series and traces to run."""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeunits import UNITS, ladder
from tidemark.operators import patterns
from tidemark.plans.engine import PatternQuery, View


#: Kinds of lines, and what the user did before a view.
KINDS, STEPS = ("visual", "pattern"), ("initial", "pan", "zoomIn", "zoomOut", "resize", "measureChange")


def parse(lines: DataFrame, header: tuple[str, ...] = ()) -> DataFrame:
    """Columns of trace lines (column `value`); lines with fewer than eight fields are left out.

    A line is from_ms, to_ms, from, to, measures (joined by |), width, height,
    accuracy, kind, and, for patterns, name, unit and segments.  header: names
    of the measures, which lines number; unit: its milliseconds.
    """
    f = F.split(F.trim("value"), ",")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    measures = F.split(at(4), r"\|")
    names = F.array(*map(F.lit, header)).cast("array<string>")
    if header:
        measures = F.transform(measures, lambda m: F.coalesce(F.get(names, F.try_to_number(m, F.lit("999")).cast("int")), m))
    pattern = at(8) == "pattern"
    unit = F.split(F.lower(at(10)), " ")
    sizes = F.create_map(*(F.lit(x) for u, ms in UNITS.items() for x in (u, ms)))
    name = F.get(unit, F.lit(1))
    ms = F.coalesce(F.try_element_at(sizes, name), F.try_element_at(sizes, F.concat(name, F.lit("s"))))
    return lines.where(F.size(f) >= 8).select(
        at(0).cast("bigint").alias("low"),
        at(1).cast("bigint").alias("high"),
        measures.alias("measures"),
        at(5).cast("int").alias("width"),
        at(6).cast("int").alias("height"),
        at(7).cast("double").alias("accuracy"),
        F.coalesce(at(8), F.lit("visual")).alias("kind"),
        at(9).alias("name"),
        F.when(pattern, F.get(unit, F.lit(0)).cast("bigint") * ms).alias("unit"),
        F.when(pattern, at(11)).alias("segments"),
    )


def queries(parsed: DataFrame) -> list[View | PatternQuery]:
    """The queries of a parsed trace, in its order, which the driver runs one by one. Predefined patterns are named shape_size."""
    out: list[View | PatternQuery] = []
    for r in parsed.collect():
        if r["kind"] != "pattern":
            out.append(View(r["low"], r["high"], tuple(r["measures"]), r["width"], r["height"], r["accuracy"]))
            continue
        shape, _, size = r["name"].rpartition("_")
        parts = patterns.parse(r["segments"]) if r["segments"] else patterns.predefined(shape, size)
        out += [PatternQuery(r["low"], r["high"], m, r["unit"], tuple(parts), r["accuracy"]) for m in r["measures"]]
    return out


@dataclass(frozen=True)
class Shape:
    """A stretch [low, high) of a measure that has a shape, which a pattern query can ask for."""

    low: int
    high: int
    name: str


#: Rises (+), falls (-) and level parts (0) of shapes; bands of angles for each, by how narrow they are.
SHAPES = {"triangle": "+-", "v_shape": "-+", "double_peak": "+-+-", "sawtooth": "+-+-+-+-"}
WIDTHS = {
    "narrow": {"+": (55, 65), "-": (-65, -55), "0": (-5, 5)},
    "medium": {"+": (45, 75), "-": (-75, -45), "0": (-10, 10)},
    "wide": {"+": (30, 89), "-": (-89, -30), "0": (-10, 10)},
}
#: Cohorts by number of segments, width of bands and number of matches.
LENGTHS = {"2seg": ("triangle", "v_shape"), "4seg": ("double_peak",), "8seg": ("sawtooth",)}
SELECTIVITY = ("many", "med", "few")
#: Buckets of a segment at least, of a view at most; share of a view that a shape takes.
LEAST_BUCKETS, MOST_BUCKETS, SHARE = 2, 50_000, (0.02, 0.5)


def spec_of(shape: Shape, unit: int, bands: str = "wide") -> str | None:
    """Segments of equal length over a shape, as patterns.parse() takes them; null if it has too few buckets."""
    signs = SHAPES[shape.name]
    total = (shape.high - shape.low) // unit
    if total < LEAST_BUCKETS * len(signs):
        return None
    sizes = [total * (i + 1) // len(signs) - total * i // len(signs) for i in range(len(signs))]
    return ";".join(f"{n}:{WIDTHS[bands][c][0]}:{WIDTHS[bands][c][1]}" for n, c in zip(sizes, signs, strict=True))


def unit_for(shape: Shape, low: int, high: int) -> int | None:
    """The narrowest width of the ladder at which a view isn't too many buckets and a shape isn't too few."""
    fits = [u for u in ladder() if (high - low) // u <= MOST_BUCKETS and (shape.high - shape.low) // u >= max(5, LEAST_BUCKETS * len(SHAPES[shape.name]))]
    return fits[0] if fits else None


@dataclass(frozen=True)
class Line:
    """A line of a trace: a view, and for patterns their unit and segments."""

    low: int
    high: int
    step: str
    unit: int = 0
    segments: str = ""

    def text(self, measure: str = "0", width: int = 1000, height: int = 600, accuracy: float = 0.95) -> str:
        """As parse() reads it."""
        day = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S")
        view = f"{self.low},{self.high},{day(self.low)},{day(self.high)},{measure},{width},{height},{accuracy}"
        return f"{view},pattern,custom,{self.unit} millis,{self.segments}" if self.segments else f"{view},visual,{self.step}"


def _around(shape: Shape, low: int, high: int, rng: random.Random) -> tuple[int, int] | None:
    """A view within [low, high) of which the shape takes a share of SHARE."""
    size = shape.high - shape.low
    wide = min(rng.randint(int(size / SHARE[1]), int(size / SHARE[0])), high - low)
    if size <= 0 or wide < size:
        return None
    a = max(low, min(shape.low - rng.randint(0, wide - size), high - wide))
    return a, a + wide


def walk(low: int, high: int, n: int, shapes: Sequence[Shape] = (), patterns_share: float = 0.5, seed: int = 42) -> list[Line]:
    """n lines over [low, high): a random walk of pans, zooms and resizes, kept inside, with pattern queries for shapes in view.

    The first view shows three quarters, where most shapes begin.
    """
    rng = random.Random(seed)
    size = max(1, (high - low) * 3 // 4)
    begins = sorted(s.low for s in shapes)
    best = max(begins, key=lambda a: bisect_left(begins, a + size) - bisect_left(begins, a), default=low)
    a = max(low, min(best - size // 4, high - size))
    out = [Line(a, a + size, "initial")]
    while len(out) < n:
        a, z = out[-1].low, out[-1].high
        if shapes and rng.random() < patterns_share:
            inside = [s for s in shapes if a <= s.low and s.high <= z and SHARE[0] <= (s.high - s.low) / (z - a) <= SHARE[1]]
            made = [(s, u) for s in inside if (u := unit_for(s, a, z)) and spec_of(s, u)]
            if made:
                s, u = rng.choice(made)
                out.append(Line(a, z, "pattern", u, spec_of(s, u)))
                continue
        step = rng.choice(("pan", "zoomIn", "zoomOut", "resize"))
        size, middle = z - a, (a + z) // 2
        if step == "pan":
            a += int(rng.uniform(0.1, 0.5) * size) * rng.choice((-1, 1))
        elif step == "zoomIn":
            size = max(1, size // 2)
            a = middle - size // 2
        elif step == "zoomOut":
            size = min(2 * size, high - low)
            a = middle - size // 2
        a = max(low, min(a, high - size))
        out.append(Line(a, a + size, step))
    return out[:n]


def cohorts(shapes: Sequence[Shape], low: int, high: int, n: int = 30, seed: int = 42) -> dict[tuple[str, str], list[Line]]:
    """Lines by (axis, cohort): what varies is the number of segments, the width of bands, or how many shapes there are of the kind asked for.

    The axes that don't vary take four segments and medium bands.  A shape
    gives one line at most, so a cohort may have fewer than n.
    """
    rng = random.Random(seed)
    count = {k: sum(s.name == k for s in shapes) for k in SHAPES}
    ranked = sorted((k for k in SHAPES if count[k]), key=lambda k: -count[k])
    wanted = {("length", k): (names, "medium") for k, names in LENGTHS.items()}
    wanted |= {("width", w): (LENGTHS["4seg"], w) for w in WIDTHS}
    for i, s in enumerate(SELECTIVITY):
        wanted["selectivity", s] = ((ranked[i * (len(ranked) - 1) // 2],) if ranked else (), "medium")
    out: dict[tuple[str, str], list[Line]] = {}
    for cohort, (names, bands) in wanted.items():
        pool = [s for s in shapes if s.name in names]
        rng.shuffle(pool)
        lines = []
        for s in pool:
            view = _around(s, low, high, rng)
            unit = unit_for(s, *view) if view else None
            spec = spec_of(s, unit, bands) if unit else None
            if spec and len(lines) < n:
                lines.append(Line(*view, "pattern", unit, spec))
        out[cohort] = lines
    return out


def synthetic(spark: SparkSession, n: int, origin: int, step: int, ids: tuple[str, ...] = ("a", "b"), period: int = 1000, seed: int = 42, every: int = 0) -> DataFrame:
    """(ts_ms, id, value): for each id a wave of `period` points with hashed noise of width 0.1, the same on every cluster.

    every: a shape of SHAPES, two units high, begins at each multiple of this
    many points and takes half of them; planted() says which.
    """
    each = spark.range(n).select("id", F.explode(F.array(*(F.lit(i) for i in ids))).alias("m"))
    noise = (F.pmod(F.xxhash64(F.col("id"), F.col("m"), F.lit(seed)), F.lit(10_001)) / 10_000 - 0.5) * 0.1
    value = F.sin(F.col("id") * (2 * 3.141592653589793 / period)) + noise
    if every:
        names = list(SHAPES)
        runs = F.array(*(F.lit(len(SHAPES[k])) for k in names))
        falls = F.array(*(F.lit(SHAPES[k][0] == "-") for k in names))
        which = F.pmod(F.floor(F.col("id") / every), F.lit(len(names))).cast("int")
        at = F.pmod(F.col("id"), F.lit(every)) / (every / 2.0)  # 0 to 1 within the shape
        x = at * F.get(runs, which)
        zigzag = 1 - F.abs(F.pmod(x, F.lit(2.0)) - 1)  # 0, 1, 0, ... at whole numbers
        value = value + F.when(at < 1, 2 * F.when(F.get(falls, which), 1 - zigzag).otherwise(zigzag)).otherwise(0.0)
    return each.select((F.col("id") * step + origin).alias("ts_ms"), F.col("m").alias("id"), value.alias("value"))


def planted(n: int, origin: int, step: int, every: int) -> list[Shape]:
    """The shapes that synthetic() puts in, for each id."""
    names = list(SHAPES)
    return [Shape(origin + i * every * step, origin + (i * every + every // 2) * step, names[i % len(names)]) for i in range(n // every)]
