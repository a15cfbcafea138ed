"""Row frames over a gap-free daily calendar, one series for each key.

Each frame has a least number of valid values; below it the result is NULL. All functions of one series share one
exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rows(lo: int, hi: int, by: tuple[str, ...] = ("px",), order: str = "day"):
    """Frame from ``lo`` to ``hi`` rows around the current one, both included."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(lo, hi)


def roll(col: str, fn, lo: int, hi: int, min_valid: int = 1, by: tuple[str, ...] = ("px",), order: str = "day") -> Column:
    """fn over a frame where it has ``min_valid`` values or more."""
    frame = rows(lo, hi, by, order)
    return F.when(F.count(col).over(frame) >= min_valid, fn(col).over(frame))


def centred(size: int) -> tuple[int, int]:
    """Ends of a centred frame; an even one has its extra row before the centre."""
    return -(size // 2), size - 1 - size // 2


def centred_mean(col: str, size: int, min_valid: int = 1, **by) -> Column:
    return roll(col, F.avg, *centred(size), min_valid, **by)


def centred_min(col: str, size: int, min_valid: int = 1, **by) -> Column:
    return roll(col, F.min, *centred(size), min_valid, **by)


def trailing_mean(col: str, size: int, min_valid: int = 1, **by) -> Column:
    """The last ``size`` days, the current one included."""
    return roll(col, F.avg, -(size - 1), 0, min_valid, **by)


def leading_min(col: str, size: int, min_valid: int = 1, **by) -> Column:
    """The next ``size`` days, the current one left out."""
    return roll(col, F.min, 1, size, min_valid, **by)


def leading_max(col: str, size: int, min_valid: int = 1, **by) -> Column:
    """``size`` days from the current one on."""
    return roll(col, F.max, 0, size - 1, min_valid, **by)


def onset(flag: str, by: tuple[str, ...] = ("px",), order: str = "day") -> Column:
    """True where a flag rises; never in the first row of a series."""
    before = F.lag(flag).over(Window.partitionBy(*by).orderBy(order))
    return F.coalesce(F.col(flag) & ~before, F.lit(False))


def first_after(cond: Column, day: str = "day", by: tuple[str, ...] = ("px",)) -> Column:
    """First day strictly after the current one on which ``cond`` holds. The order is reversed so that the frame grows row by row."""
    back = Window.partitionBy(*by).orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.min(F.when(cond, F.col(day))).over(back)
