"""Event composites: a variable around event starts, by lag and any groups.

One operator for all of them. Each event is exploded to its lags and meets the panel by an inner equi-join on place and
day, so that few events are broadcast and the panel is read where it lies, or the panel is cut to the events' places and
days before it is shuffled. One empty row for each group and lag stands for values outside the record. Partial and final aggregation do the
rest, so tiles and merges fall away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import roll


def aligned(events: DataFrame, panel: DataFrame, lags: int, cols: list[str], by: list[str], across: list[str] | None = None, start: str = "start") -> DataFrame:
    """by, across, lag and the panel's columns for each event, lag and panel row of that place and day, and an empty row for each group and lag.

    ``by`` are columns of the events, ``across`` of the panel (a variable's name, say): rows of the panel then repeat a place
    and day for each of their values.
    """
    across = across or []
    lag = F.explode(F.sequence(F.lit(-lags), F.lit(lags)))
    spread = events.select("px", F.col(start).alias("_start"), *by).withColumn("lag", lag).withColumn("day", F.date_add("_start", F.col("lag"))).drop("_start")
    rows = panel.select("px", "day", *across, *cols).join(spread, ["px", "day"]).select(*by, *across, "lag", *cols)
    groups = events.select(*by).distinct() if by else events.limit(1).select(F.lit(1).alias("_one"))
    kinds = dict(panel.dtypes)
    nothing = groups.select(*by, *[F.lit(None).cast(kinds[c]).alias(c) for c in across], lag.alias("lag"), *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    return rows if across else rows.unionByName(nothing)


def composite(events: DataFrame, panel: DataFrame, value: str, lags: int = 60, by: list[str] | None = None, weight: str | None = None, least: float | None = None, spread: bool = False, across: list[str] | None = None) -> DataFrame:
    """lag, composite_mean, composite_n (and composite_std, or with a weight composite_total_obs) by lag and groups.

    With a weight: sum(w x) / sum(w) over days with a value; days with a weight below ``least`` are missing. ``across`` names
    columns of the panel that group too, so that one pass makes the composites of many variables; lags of theirs that
    no row of the panel has are then left out.
    """
    by, across = by or [], across or []
    rows = aligned(events, panel, lags, [value] + ([weight] if weight else []), by, across)
    x = F.col(value)
    if weight and least is not None:
        x = F.when(F.col(weight) >= least, x)
    if weight is None:
        aggs = [F.avg(x).alias("composite_mean"), F.count(x).alias("composite_n")]
        if spread:
            aggs.append(F.stddev_pop(x).alias("composite_std"))
    else:
        w = F.when(x.isNotNull(), F.col(weight).cast("double"))
        aggs = [F.try_divide(F.sum(w * x), F.sum(w)).alias("composite_mean"), F.count(x).alias("composite_n"), F.coalesce(F.sum(w), F.lit(0.0)).alias("composite_total_obs")]
    return rows.groupBy(*by, *across, "lag").agg(*aggs)


def smoothed(comp: DataFrame, size: int = 10, by: list[str] | None = None) -> DataFrame:
    """composite_mean smoothed over lags, centred; an even size has its extra lag before the centre."""
    by = by or []
    keyed = comp.withColumn("_one", F.lit(0))
    return keyed.withColumn("composite_smooth", roll("composite_mean", F.avg, -(size // 2), size - 1 - size // 2, 1, (*by, "_one"), "lag")).drop("_one")
