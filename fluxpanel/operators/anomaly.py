"""Smoothed day-of-year climatologies, anomalies and detrending.

The pool of a place and calendar day is every value within ``half`` days of that day in any year; 29 February is a day of
its own. Sums of the pool come from running frames, so nothing is exploded; values are taken from each place's mean first,
which keeps the digits of the squares. All of it is windows of one place, which share one exchange: the panel is read once,
and no climatology is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import rows

#: Below this the spread of a pool is rounding of its sums.
LEAST_STD = 1e-7
SUMS = ["_s", "_k", "_s2", "_q2", "_k2"]


def _running(panel: DataFrame, col: str, mean_half: int, std_half: int, px: str, day: str) -> DataFrame:
    """The panel with _md, the place's mean _c and, of the values less it, the running sums and counts SUMS."""
    out = panel.withColumns({"_c": F.avg(col).over(Window.partitionBy(px)), "_md": F.date_format(day, "MM-dd")}).withColumn("_x", F.col(col) - F.col("_c"))
    fm, fs = rows(-mean_half, mean_half, (px,), day), rows(-std_half, std_half, (px,), day)
    sums = [F.sum("_x").over(fm), F.count("_x").over(fm), F.sum("_x").over(fs), F.sum(F.col("_x") * F.col("_x")).over(fs), F.count("_x").over(fs)]
    return out.withColumns(dict(zip(SUMS, sums, strict=True))).drop("_x")


def _moments(centre: Column, total) -> tuple[Column, Column]:
    """(mean, population std) from the sums over a pool; a std of zero (below LEAST_STD, that is) is NULL."""
    s, k, s2, q2, k2 = map(total, SUMS)
    m2 = F.try_divide(s2, k2)
    std = F.sqrt(F.greatest(F.try_divide(q2, k2) - m2 * m2, F.lit(0.0)))
    return centre + F.try_divide(s, k), F.when(std > LEAST_STD, std)


def climatology(panel: DataFrame, col: str, mean_half: int = 3, std_half: int = 3, px: str = "px", day: str = "day") -> DataFrame:
    """px, md, clim_mean, clim_std (population); a std of zero (below LEAST_STD, that is) is NULL."""
    g = _running(panel.select(px, day, col), col, mean_half, std_half, px, day).groupBy(px, F.col("_md").alias("md")).agg(F.max("_c").alias("_c"), *[F.sum(c).alias(c) for c in SUMS])
    mean, std = _moments(F.col("_c"), F.col)
    return g.select(px, "md", mean.alias("clim_mean"), std.alias("clim_std"))


def with_climatology(panel: DataFrame, col: str, px: str = "px", day: str = "day", mean_half: int = 3, std_half: int = 3) -> DataFrame:
    """Adds clim_mean and clim_std of each row's place and calendar day. The pool's window is over place and calendar day, which the exchange by place serves too."""
    pool = Window.partitionBy(px, "_md")
    out = _running(panel, col, mean_half, std_half, px, day).withColumns({c: F.sum(c).over(pool) for c in SUMS})
    mean, std = _moments(F.col("_c"), F.col)
    return out.withColumns({"clim_mean": mean, "clim_std": std}).drop("_c", "_md", *SUMS)


def standardised(panel: DataFrame, col: str, name: str = "z", detrend: bool = False, **kw) -> DataFrame:
    """Adds (value - mean) / std; NULL where the value is missing or the std is zero."""
    if detrend:
        panel = detrended(panel, col, name=col)
    out = with_climatology(panel, col, **kw)
    return out.withColumn(name, (F.col(col) - F.col("clim_mean")) / F.col("clim_std")).drop("clim_mean", "clim_std")


def departures(panel: DataFrame, col: str, name: str = "d", **kw) -> DataFrame:
    """Adds value - mean."""
    return with_climatology(panel, col, **kw).withColumn(name, F.col(col) - F.col("clim_mean")).drop("clim_mean", "clim_std")


def observed_climatology(panel: DataFrame, col: str, **kw) -> DataFrame:
    """Adds clim_mean and clim_std where the value is there and not zero."""
    seen = F.col(col).isNotNull() & (F.col(col) != 0)
    return with_climatology(panel, col, **kw).withColumns({c: F.when(seen, F.col(c)) for c in ("clim_mean", "clim_std")})


def detrended(panel: DataFrame, col: str, name: str = "detrended", px: str = "px", day: str = "day") -> DataFrame:
    """Takes each place's least-squares line off. A place without values stays as it is; one with a single value becomes 0."""
    place = Window.partitionBy(px)
    out = panel.withColumn("_i", F.datediff(F.col(day), F.min(day).over(place)).cast("double"))
    out = out.withColumns({"_m": F.coalesce(F.regr_slope(col, "_i").over(place), F.lit(0.0)), "_x": F.avg(F.when(F.col(col).isNotNull(), F.col("_i"))).over(place), "_y": F.avg(col).over(place)})
    return out.withColumn(name, F.col(col) - (F.col("_y") + F.col("_m") * (F.col("_i") - F.col("_x")))).drop("_i", "_m", "_x", "_y")
