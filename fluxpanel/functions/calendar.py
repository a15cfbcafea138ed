"""Seasons, land-cover years and day windows."""

from __future__ import annotations

from calendar import month_name

from pyspark.sql import Column
from pyspark.sql import functions as F


def season_months(abbr: str) -> list[int]:
    """Months of a season given by the initials of two to twelve months in a row, e.g. DJF -> [12, 1, 2]; the first such run of the year."""
    if 2 <= len(abbr) <= 12:
        for first in range(1, 13):
            run = [m if m <= 12 else m - 12 for m in range(first, first + len(abbr))]
            if all(month_name[m].startswith(c) for m, c in zip(run, abbr, strict=True)):
                return run
    raise KeyError(f"not a season of two or more months in a row: {abbr}")


def in_season(day: Column, abbr: str) -> Column:
    return F.month(day).isin(season_months(abbr))


def nearest_stamp_year(day: Column, first: int, last: int, month: int = 7, dom: int = 2) -> Column:
    """Year whose stamp (2 July by default) is nearest to the day; the earlier one in a tie; years outside first..last are not used."""
    y = F.year(day)
    stamp = lambda k: F.make_date(y + k, F.lit(month), F.lit(dom))
    this = F.datediff(day, stamp(0))
    before = F.when(F.datediff(day, stamp(-1)) <= -this, y - 1).otherwise(y)
    after = F.when(F.datediff(stamp(1), day) < this, y + 1).otherwise(y)
    return F.least(F.greatest(F.when(this < 0, before).otherwise(after), F.lit(first)), F.lit(last))
