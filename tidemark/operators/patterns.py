"""Search for sequences of segments whose slope angles lie in given bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import workspace
from tidemark.operators import buckets, slopes
from tidemark.sources.series import within


@dataclass(frozen=True)
class Segment:
    """shortest..longest buckets with an angle in [low, high] degrees, taken at_least..at_most times (None: without end)."""

    shortest: int
    longest: int
    low: float = -90.0
    high: float = 90.0
    at_least: int = 1
    at_most: int | None = 1

    def __post_init__(self) -> None:
        if not 1 <= self.shortest <= self.longest or not -90 <= self.low <= self.high <= 90 or not _times(self):
            raise ValueError(f"no segment: {self}")

    @property
    def any(self) -> bool:
        return self.low == -90 and self.high == 90


@dataclass(frozen=True)
class Group:
    """Segments and groups, one after the other, taken at_least..at_most times (None: without end)."""

    parts: tuple[Segment | Group, ...]
    at_least: int = 1
    at_most: int | None = 1

    def __post_init__(self) -> None:
        if not self.parts or not _times(self):
            raise ValueError(f"no group: {self}")


def _times(x: Segment | Group) -> bool:
    return 0 <= x.at_least and (x.at_most is None or max(1, x.at_least) <= x.at_most)


#: Bands of angles by name.
BANDS = {"any": (-90, 90), "increasing": (10, 80), "increasing moderate": (10, 45), "increasing large": (45, 80)}
BANDS |= {"decreasing": (-80, -10), "decreasing moderate": (-45, -10), "decreasing large": (-80, -45), "stable": (-10, 10)}


def band(name: str, a: int, b: int) -> Segment:
    """A segment of a..b buckets in a band of BANDS."""
    return Segment(a, b, *BANDS[name])


def increasing(a: int, b: int) -> Segment:
    return band("increasing", a, b)


def decreasing(a: int, b: int) -> Segment:
    return band("decreasing", a, b)


def stable(a: int, b: int) -> Segment:
    return band("stable", a, b)


#: Buckets of each segment of predefined patterns, by size.
SIZES = {"small": 5, "mid": 15, "big": 25}
#: Bands of the segments of predefined patterns.
SHAPES = {
    "v_shape": ("decreasing large", "increasing large"),
    "plateau": ("increasing large", "stable", "decreasing large"),
    "oscillating": ("increasing large", "decreasing large"),
}


def predefined(name: str, size: str) -> list[Segment]:
    """A pattern of SHAPES in a size of SIZES."""
    return [band(b, SIZES[size], SIZES[size]) for b in SHAPES[name]]


def repeat(segments: Sequence[Segment], low: int, high: int) -> list[list[Segment]]:
    """A group taken low..high times, written out; the empty sequence is left out."""
    return [list(segments) * k for k in range(max(1, low), high + 1)]


def parse(spec: str) -> list[Segment]:
    """Segments from "len:low:high;...", len a number or a-b, low:high numbers or "*:*"; "*", "+", "?" or "{a,b}" may follow: how often."""
    out = []
    for part in filter(None, (x.strip() for x in spec.split(";"))):
        size, low, high = part.split(":")
        high, times = _repetition(high)
        a, _, b = size.partition("-")
        out.append(Segment(int(a), int(b or a), -90.0 if low == "*" else float(low), 90.0 if high == "*" else float(high), *times))
    return out


def _repetition(text: str) -> tuple[str, tuple[int, int | None]]:
    if text.endswith("}"):
        text, _, inner = text[:-1].partition("{")
        low, comma, high = inner.partition(",")
        return text, (int(low), (int(high) if high else None) if comma else int(low))
    ends = {"+": (1, None), "?": (0, 1)} | ({"*": (0, None)} if len(text) > 1 else {})
    return (text[:-1], ends[text[-1]]) if text[-1] in ends else (text, (1, 1))


def sequences(parts: Sequence[Segment | Group], longest: int) -> list[list[Segment]]:
    """All sequences of plain segments that a pattern stands for, within `longest` buckets; the empty one is left out.

    Repetition without end is written out as far as `longest` reaches, so it is
    for patterns of few alternatives; regex_matches() has no such limit.
    """

    def of(x: Segment | Group) -> Iterator[tuple[Segment, ...]]:
        once = [(Segment(x.shortest, x.longest, x.low, x.high),)] if isinstance(x, Segment) else list(chains(x.parts))
        least = min((sum(s.shortest for s in c) for c in once if c), default=longest)
        most = max(x.at_least, longest // max(1, least)) if x.at_most is None else x.at_most
        seen = set()
        for k in range(x.at_least, most + 1):
            for picked in product(once, repeat=k):
                made = tuple(s for c in picked for s in c)
                if made not in seen and sum(s.shortest for s in made) <= longest:
                    seen.add(made)
                    yield made

    def chains(xs: Sequence[Segment | Group]) -> Iterator[tuple[Segment, ...]]:
        for picked in product(*(list(of(x)) for x in xs)):
            made = tuple(s for c in picked for s in c)
            if sum(s.shortest for s in made) <= longest:
                yield made

    return [list(c) for c in dict.fromkeys(chains(parts)) if c]


def grid(series: DataFrame, width: int, origin: int, n: int) -> DataFrame:
    """regression_sums() of buckets 0..n-1 that hold points."""
    return buckets.regression_sums(within(series, origin, origin + n * width), width, origin)


def _candidates(table: DataFrame, segments: Sequence[Segment]) -> DataFrame:
    """(id, b, len, angle) of all runs that some segment could be, made in one pass and written down where several segments read them."""
    low, high = min(s.shortest for s in segments), max(s.longest for s in segments)
    found = slopes.runs(table, low, high)
    if len(set(segments)) == 1:
        return found
    fits = [F.col("len").between(s.shortest, s.longest) & F.col("angle").between(s.low, s.high) for s in dict.fromkeys(segments)]
    return workspace.written(found.where(reduce(Column.__or__, fits)), "runs")


def matches(table: DataFrame, segments: Sequence[Segment], n: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """(id, b, to, lens, a0, a1, ...) of every match: segments follow each other, each over non-empty buckets with its angle in its band.

    table: grid() or any regression_sums(); n: matches end by bucket n.  found:
    runs that were made before.
    """
    if any(s.at_least != 1 or s.at_most != 1 for s in segments):
        raise ValueError("repeated segments: see sequences() and regex_matches()")
    found = _candidates(table, segments) if found is None else found
    out = None
    for i, s in enumerate(segments):
        got = found.where(F.col("len").between(s.shortest, s.longest) & F.col("angle").between(s.low, s.high))
        if out is None:
            out = got.select("id", "b", (F.col("b") + F.col("len")).alias("to"), F.array("len").alias("lens"), F.col("angle").alias("a0"))
        else:
            nxt = got.select("id", F.col("b").alias("to"), F.col("len").alias("more"), F.col("angle").alias(f"a{i}"))
            out = out.join(nxt, ["id", "to"]).withColumn("to", F.col("to") + F.col("more")).withColumn("lens", F.concat("lens", F.array("more"))).drop("more")
    if n is not None:
        out = out.where(F.col("to") <= n)
    return out.withColumn("lens", _text("lens"))


def _text(lens: str) -> Column:
    return F.array_join(F.transform(lens, lambda x: F.lpad(x.cast("string"), 3, "0")), "-")


def select(found: DataFrame, longest: bool = True) -> DataFrame:
    """The longest (shortest) match at each start; ties go to the smallest lengths in order."""
    size = F.col("to") - F.col("b")
    by = Window.partitionBy("id", "b").orderBy(size.desc() if longest else size.asc(), "lens")
    return found.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def without_overlap(best: DataFrame) -> DataFrame:
    """From the left, each match that begins where the one taken before has ended. best: one match at each start.

    One id's starts are walked in order by one task, batch by batch.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        keep, end = [], None
        for b, to in zip(pdf["b"], pdf["to"], strict=True):
            keep.append(end is None or b >= end)
            end = to if keep[-1] else end
        return pdf[keep]

    return best.groupBy("id").applyInPandas(walk, best.schema)


def classified(bounds: DataFrame, low: float, high: float, accuracy: float) -> DataFrame:
    """Bounds (id, b, lo, hi, defined) that meet the band, with overshoot and whether it is at most 1 - accuracy.

    Runs whose bounds are undefined may match as well: they come with a null
    overshoot and aren't confident, so that refinement takes them in.
    """
    over = slopes.overshoot(F.col("lo"), F.col("hi"), low, high)
    met = bounds.where(~F.col("defined") | ((F.col("hi") >= low) & (F.col("lo") <= high))).withColumn("overshoot", F.when(F.col("defined"), over))
    return met.withColumn("confident", F.coalesce(F.col("overshoot") <= 1 - accuracy, F.lit(False)))


def relaxed(sub: DataFrame, factor: int, segments: Sequence[Segment], accuracy: float, n: int | None = None) -> DataFrame:
    """(id, b, to, lens, overshoot, confident, defined) of matches by bounds alone, from aggregate() of sub-buckets.

    A segment may match where its bounds meet its band, or are undefined.  The
    overshoot of a match is the chance that some segment misses its band, 1 -
    the product over segments of 1 - overshoot; segments of any angle have
    none.  It is confident if that is at most 1 - accuracy and all bounds are
    defined; with an undefined one the overshoot is 1.
    """
    lengths = sorted({k for s in segments for k in range(s.shortest, s.longest + 1)})
    every = reduce(DataFrame.unionByName, (slopes.interval(sub, factor, k).withColumn("len", F.lit(k)) for k in lengths))
    every = workspace.written(every, "bounds")
    out = None
    for s in segments:
        t = every.where(F.col("len").between(s.shortest, s.longest))
        if s.any:
            t = t.withColumn("o", F.lit(0.0)).withColumn("d", F.lit(True))
        else:
            t = classified(t, s.low, s.high, accuracy).select("*", F.coalesce("overshoot", F.lit(1.0)).alias("o"), F.col("defined").alias("d"))
        t = t.select("id", "b", "len", "o", "d")
        if out is None:
            out = t.select("id", "b", (F.col("b") + F.col("len")).alias("to"), F.array("len").alias("lens"), (1 - F.col("o")).alias("sure"), F.col("d").alias("defined"))
        else:
            t = t.withColumnRenamed("b", "to")
            joined = out.join(t, ["id", "to"])
            kept = [(F.col("to") + F.col("len")).alias("to"), F.concat("lens", F.array("len")).alias("lens")]
            out = joined.select("id", "b", *kept, (F.col("sure") * (1 - F.col("o"))).alias("sure"), (F.col("defined") & F.col("d")).alias("defined"))
    if n is not None:
        out = out.where(F.col("to") <= n)
    confident = F.col("defined") & (1 - F.col("sure") <= 1 - accuracy)
    return out.select("id", "b", "to", _text("lens").alias("lens"), (1 - F.col("sure")).alias("overshoot"), confident.alias("confident"), "defined")


def decision_error(found: DataFrame) -> DataFrame:
    """(error, confident, ambiguous): the overshoot of unconfident matches over the number of all; 0 without any."""
    doubt = F.sum(F.when(~F.col("confident"), F.coalesce("overshoot", F.lit(1.0))).otherwise(0.0))
    return found.agg(F.when(F.count("*") > 0, doubt / F.count("*")).otherwise(0.0).alias("error"), F.count_if("confident").alias("confident"), F.count_if(~F.col("confident")).alias("ambiguous"))


def verified(found: DataFrame, exact: DataFrame) -> DataFrame:
    """found (id, b, to, lens) with whether an exact match has the same segments."""
    mark = exact.select("id", "b", "to", "lens").distinct().withColumn("exact", F.lit(True))
    return found.join(mark, ["id", "b", "to", "lens"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def alternatives(table: DataFrame, choices: Sequence[Sequence[Segment]], n: int | None = None) -> DataFrame:
    """(id, b, to, lens, a0) of matches of any of the sequences, as repeat() or sequences() write them out; each match once."""
    if not choices:
        raise ValueError("no sequence that isn't empty fits")
    runs = _candidates(table, [s for c in choices for s in c])
    found = [matches(table, c, n, runs).select("id", "b", "to", "lens", "a0") for c in choices]
    return reduce(DataFrame.unionByName, found).dropDuplicates(["id", "b", "to", "lens"])


class Automaton:
    """States of a pattern; steps (state, segment, next) read a segment, free (state, next) read nothing."""

    def __init__(self, parts: Sequence[Segment | Group]):
        self.segments: list[Segment] = []
        self.steps: list[tuple[int, int, int]] = []
        self.free: list[tuple[int, int]] = []
        self.states = 1
        self.end = self._chain(0, parts)

    def _new(self) -> int:
        self.states += 1
        return self.states - 1

    def _chain(self, at: int, parts: Sequence[Segment | Group]) -> int:
        for x in parts:
            at = self._repeated(at, x)
        return at

    def _once(self, at: int, x: Segment | Group) -> int:
        if isinstance(x, Group):
            return self._chain(at, x.parts)
        to = self._new()
        self.segments.append(x)
        self.steps.append((at, len(self.segments) - 1, to))
        return to

    def _repeated(self, at: int, x: Segment | Group) -> int:
        for _ in range(x.at_least):
            at = self._once(at, x)
        if x.at_most is None:
            head = self._new()  # so that the loop can't be entered from what follows
            self.free += [(at, head), (self._once(head, x), head)]
            return head
        ends = [at]
        for _ in range(x.at_most - x.at_least):
            at = self._once(at, x)
            ends.append(at)
        out = self._new()
        self.free += [(e, out) for e in ends]
        return out

    def order(self) -> list[int]:
        """States so that free steps lead to earlier ones; loops of free steps come in any order."""
        out, seen = [], set()

        def visit(s: int) -> None:
            if s not in seen:
                seen.add(s)
                for a, b in self.free:
                    if a == s:
                        visit(b)
                out.append(s)

        for s in range(self.states):
            visit(s)
        return out

    def dot(self) -> str:
        """The automaton in the DOT language."""
        s = lambda i: f"{self.segments[i].shortest}-{self.segments[i].longest}: {self.segments[i].low:g}..{self.segments[i].high:g}"
        lines = [f"  {self.end} [shape=doublecircle];"]
        lines += [f'  {a} -> {b} [label="{s(i)}"];' for a, i, b in self.steps] + [f"  {a} -> {b} [style=dashed];" for a, b in self.free]
        return "digraph pattern {\n  rankdir=LR;\n" + "\n".join(lines) + "\n}"

    def ends(self, starts: dict[int, list[list[int]]], last: int) -> dict[int, int]:
        """The ends of matches from each start, as the bits of a number. starts: by bucket, the lengths that fit each segment.

        From the last bucket back, the ends that each state reaches from each
        bucket are put together from those of the buckets after it.
        """
        reach = [dict() for _ in range(self.states)]
        order, found = self.order(), {}
        for b in range(last, -1, -1):
            lengths = starts.get(b)
            now = [0] * self.states
            now[self.end] = 1 << b
            for a, i, to in self.steps:
                for k in lengths[i] if lengths else ():
                    now[a] |= reach[to].get(b + k, 0)
            changed = True
            while changed:  # again, where loops lead back
                before = list(now)
                for s in order:
                    for a, to in self.free:
                        if a == s:
                            now[s] |= now[to]
                changed = now != before
            for s in range(self.states):
                if now[s]:
                    reach[s][b] = now[s]
            if ends := now[0] & ~(1 << b):
                found[b] = ends
        return found


def regex_matches(table: DataFrame, parts: Sequence[Segment | Group], n: int, longest: bool = True) -> DataFrame:
    """(id, b, to): the longest (shortest) match at each start of a pattern with any repetition; empty ones are left out.

    Runs are made and filtered by all tasks; one id's runs that fit some
    segment, at most buckets times lengths, are then walked by one task.
    """
    machine = Automaton(parts)
    segments = machine.segments
    fits = [F.when(F.col("len").between(s.shortest, s.longest) & F.col("angle").between(s.low, s.high), F.lit(i)) for i, s in enumerate(segments)]
    runs = slopes.runs(table, min(s.shortest for s in segments), max(s.longest for s in segments))
    runs = runs.select("id", "b", "len", F.array_compact(F.array(*fits)).alias("fits")).where(F.size("fits") > 0)
    count = len(segments)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        starts: dict[int, list[list[int]]] = {}
        for b, k, of in zip(pdf["b"], pdf["len"], pdf["fits"], strict=True):
            if b + k <= n:
                lengths = starts.setdefault(int(b), [[] for _ in range(count)])
                for i in of:
                    lengths[i].append(int(k))
        ends = machine.ends(starts, n)
        pick = (lambda x: x.bit_length() - 1) if longest else (lambda x: (x & -x).bit_length() - 1)
        rows = [(pdf["id"].iloc[0], b, pick(x)) for b, x in sorted(ends.items())]
        return pd.DataFrame(rows, columns=["id", "b", "to"])

    return runs.groupBy("id").applyInPandas(walk, "id string, b bigint, to bigint")


def row_pattern(sums: DataFrame, segments: Sequence[Segment], n: int | None = None) -> DataFrame:
    """matches() over non-empty buckets alone, as SQL row patterns see them: gaps are bridged, and one candidate of fixed lengths begins at each row.

    b and to count the non-empty buckets of an id.
    """
    if any(s.shortest != s.longest for s in segments):
        raise ValueError("row patterns have fixed lengths")
    ranked = sums.where("n > 0").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("b")).cast("long") - 1)
    return matches(ranked.withColumnRenamed("b", "x0").withColumnRenamed("rank", "b"), segments, n)


def ambiguous_regions(found: DataFrame, length: int | None, pad: int, n: int, gap: int = 0) -> DataFrame:
    """(id, low, high): buckets around the unconfident matches, padded, cut to 0..n and merged where at most `gap` buckets lie between.

    length: that of all matches; None: found has `to`.
    """
    to = F.col("to") if length is None else F.col("b") + length
    t = found.where(~F.col("confident")).select("id", F.greatest(F.col("b") - pad, F.lit(0)).alias("low"), F.least(to + pad, F.lit(n)).alias("high"))
    by = Window.partitionBy("id").orderBy("low", "high")
    reached = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("new", F.coalesce(F.col("low") - reached > gap, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("id", "k").agg(F.min("low").cast("long").alias("low"), F.max("high").cast("long").alias("high")).select("id", "low", "high")
