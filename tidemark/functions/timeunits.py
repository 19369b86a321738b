"""Widths, alignment and intervals of time, in milliseconds."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column
from pyspark.sql import functions as F

MS, SECOND, MINUTE, HOUR, DAY = 1, 1000, 60_000, 3_600_000, 86_400_000


def ladder() -> list[int]:
    """Widths that divide the next larger unit: of a second, a minute, an hour and a day."""
    out = {DAY}
    for unit, n in ((MS, 1000), (SECOND, 60), (MINUTE, 60), (HOUR, 24)):
        out |= {unit * k for k in range(1, n) if n % k == 0}
    return sorted(out)


def divides(width: int, wider: int) -> bool:
    """Whether buckets of `width` can be put together to buckets of `wider`."""
    return 0 < width <= wider and wider % width == 0


def snap_down(width: int) -> int:
    steps = ladder()
    return steps[max(0, bisect_right(steps, width) - 1)]


def snap_up(width: int) -> int:
    steps = ladder()
    return steps[min(len(steps) - 1, bisect_left(steps, width))]


def align(low: int, high: int, width: int) -> tuple[int, int]:
    """The grid of `width` around [low, high)."""
    return low - low % width, -(-high // width) * width


#: Milliseconds of the units that workloads name; a month has 30 days and a year 365.
UNITS = {"millis": MS, "seconds": SECOND, "minutes": MINUTE, "hours": HOUR, "days": DAY, "weeks": 7 * DAY, "months": 30 * DAY, "years": 365 * DAY}


def width_of(text: str) -> int:
    """Milliseconds of a width as workloads write it: a number and a unit of UNITS."""
    number, _, unit = text.strip().lower().partition(" ")
    unit = unit if unit in UNITS else unit + "s"
    if unit not in UNITS or int(number) < 1:
        raise ValueError(f"no width: {text}")
    return int(number) * UNITS[unit]


def day_align(low: int, high: int, times: int, unit: int) -> tuple[int, int]:
    """The grid of `times` units around [low, high), counted from the start of each end's day.

    A single unit always goes one on at the upper end, also where it is on the
    grid; several only where something is left.
    """
    width = times * unit
    if width > DAY:
        raise ValueError("wider than a day")
    down = lambda x: x - x % DAY + x % DAY // width * width
    if times == 1:
        return down(low), down(high) + width
    return down(low), high if down(high) == high else min(down(high) + width, high - high % DAY + DAY)


def buckets_between(low: int, high: int, width: int) -> int:
    """How many buckets of `width` it takes to cover [low, high)."""
    return max(0, -(-(high - low) // width))


def index_of(ms: Column, low: int, width: int) -> Column:
    """Which bucket of `width` from `low` on holds a time."""
    return F.floor((ms - F.lit(low)) / width).cast("long")


def to_text(ms: Column, fmt: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """A time as text, in the session's zone, which is UTC here."""
    return F.date_format(F.timestamp_millis(ms), fmt)


def from_text(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    """Milliseconds of a text; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(fmt)))


def calendar_bucket(ms: Column, times: int, unit: str) -> Column:
    """Start of the bucket of `times` calendar units (second, minute, hour, day, month) that holds a time.

    Several units count within the next larger one, so the last bucket of a
    minute, hour, day, month or year may be shorter; days and months count
    from 1.
    """
    parts = {"second": ("minute", F.second), "minute": ("hour", F.minute), "hour": ("day", F.hour), "day": ("month", F.dayofmonth), "month": ("year", F.month)}
    at = F.timestamp_millis(ms)
    if unit not in parts:
        raise ValueError(f"no calendar unit: {unit}")
    if times == 1:
        return F.unix_millis(F.date_trunc(unit, at))
    outer, number = parts[unit]
    first = 1 if unit in ("day", "month") else 0
    steps = (F.floor((number(at) - first) / times) * times).cast("int")
    start = F.date_trunc(outer, at)
    zero = F.lit(0)
    if unit == "month":
        return F.unix_millis(start + F.make_ym_interval(zero, steps))
    place = {"day": (steps, zero, zero, zero), "hour": (zero, steps, zero, zero), "minute": (zero, zero, steps, zero), "second": (zero, zero, zero, steps)}[unit]
    return F.unix_millis(start + F.make_dt_interval(*place))


def bucket(width: int, origin: int = 0) -> Column:
    """Index of the bucket of ts_ms, counted from origin."""
    x = F.col("ts_ms") - F.lit(origin)
    return ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")


def group_intervals(intervals: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Intervals merged where at most `gap` lies between them."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def next_factor(current: int, error: float, target: float, cap: int = 0) -> int | None:
    """The aggregation factor to try next: the same if the error is low enough, else twice; None beyond a positive cap or 2^20."""
    if error <= target:
        return current
    doubled = 2 * current
    return None if doubled > (cap if cap > 0 else 1 << 20) else doubled
