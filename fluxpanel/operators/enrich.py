"""Window aggregates of a variable around each event, added to the catalogue as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import centred_mean


def column_name(var: str, kind: str, first: int, last: int, weighted: bool = False, smooth: int | None = None, prefix: str = "std_anom") -> str:
    return f"{prefix}_{var}_{kind}_{first}_{last}{'_nweighted' * weighted}{f'_smooth{smooth}' if smooth else ''}"


def inside(first: int, last: int, span: tuple) -> Column:
    """Whether a start lies in the record and so does its window, which must end before the last day."""
    lo, hi = (F.lit(str(x)).cast("date") for x in span)
    return (F.col("start") >= lo) & (F.col("start") <= hi) & (F.date_add("start", first) >= lo) & (F.date_add("start", last + 1) <= hi)


def _windowed(catalogue: DataFrame, panel: DataFrame, first: int, last: int, cols: list[str], span: tuple) -> DataFrame:
    """The panel's rows in the windows that lie in the record. The join is an inner one, so that few events are broadcast, or cut the panel before it is shuffled."""
    starts = catalogue.select("px", "start").filter(inside(first, last, span)).distinct()
    days = starts.withColumn("day", F.explode(F.sequence(F.date_add("start", first), F.date_add("start", last))))
    return panel.select("px", "day", *cols).join(days, ["px", "day"])


def span_of(panel: DataFrame) -> tuple:
    return tuple(panel.agg(F.min("day"), F.max("day")).first())


def add_window(catalogue: DataFrame, panel: DataFrame, value: str, var: str, kind: str, first: int, last: int, smooth: int | None = None, span: tuple | None = None) -> DataFrame:
    """Adds mean, min, max or sum over start+first .. start+last. A window outside of the record, or one that reaches its last day, gives NULL; a sum over no values is 0."""
    span = span or span_of(panel)
    if smooth:
        panel = panel.withColumn(value, centred_mean(value, smooth, 2))
    rows = _windowed(catalogue, panel, first, last, [value], span)
    name = column_name(var, kind, first, last, smooth=smooth)
    out = rows.groupBy("px", "start").agg({"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[kind](value).alias(name))
    out = catalogue.join(out, ["px", "start"], "left")
    return out.withColumn(name, F.when(inside(first, last, span), F.coalesce(F.col(f"`{name}`"), F.lit(0.0)))) if kind == "sum" else out


def add_window_by_sums(catalogue: DataFrame, panel: DataFrame, value: str, var: str, kind: str, first: int, last: int, smooth: int | None = None, span: tuple | None = None) -> DataFrame:
    """What ``add_window`` adds, by two lookups an event, however long the window is.

    Mean and sum are differences of running sums. Minimum and maximum are those of two stretches of 2**k days, the greatest power within the
    window, which begin and end with it; stretches double in length by looking half of one ahead. All of it is one pass over the
    gap-free panel by place.
    """
    span = span or span_of(panel)
    series = Window.partitionBy("px").orderBy("day")
    rows = panel.select("px", "day", (centred_mean(value, smooth, 2) if smooth else F.col(value)).alias("_x"))
    if kind in ("mean", "sum"):
        upto = series.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"_s": F.coalesce(F.sum("_x").over(upto), F.lit(0.0)), "_n": F.count("_x").over(upto)}).drop("_x")
        ends, cols = (first - 1, last), ["_s", "_n"]
    else:
        best, size = {"min": F.least, "max": F.greatest}[kind], 1
        while 2 * size <= last - first + 1:
            rows, size = rows.withColumn("_x", best("_x", F.lead("_x", size).over(series))), 2 * size
        ends, cols = (first, last - size + 1), ["_x"]
    starts = catalogue.select("px", "start").filter(inside(first, last, span)).distinct()
    wanted = starts.withColumn("_e", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.date_add("start", e).alias("day")) for i, e in enumerate(ends)]))).select("px", "start", "_e.i", "_e.day")
    met = rows.select("px", "day", *cols).join(wanted, ["px", "day"]).groupBy("px", "start")
    name = column_name(var, kind, first, last, smooth=smooth)
    if kind in ("mean", "sum"):
        # a window that begins with the record has nothing before it
        upto = lambda c: F.sum(F.when(F.col("i") == 1, F.col(c)).otherwise(-F.col(c)))
        out = met.agg(upto("_s").alias("_s"), upto("_n").alias("_n")).select("px", "start", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n") if kind == "mean" else F.col("_s")).alias(name))
    else:
        out = met.agg({"min": F.min, "max": F.max}[kind]("_x").alias(name))
    out = catalogue.join(out, ["px", "start"], "left")
    return out.withColumn(name, F.when(inside(first, last, span), F.coalesce(F.col(f"`{name}`"), F.lit(0.0)))) if kind == "sum" else out


def add_weighted_window(catalogue: DataFrame, panel: DataFrame, value: str, n: str, var: str, kind: str, first: int, last: int, least: float, smooth: int | None = None, span: tuple | None = None, compat_argmin: bool = False) -> DataFrame:
    """Adds a count-weighted mean, or the min or max with the count on that day (the first such day).

    Smoothing is of values and counts; then values with a count below ``least`` are missing. The mean's count is over all
    days of the window, missing values too. Nothing valid, or a window outside of the record: NULL and 0. ``compat_argmin``
    takes the minimum where the maximum is asked for, as older results have it.
    """
    span = span or span_of(panel)
    if smooth:
        panel = panel.select("px", "day", centred_mean(value, smooth, 2).alias(value), centred_mean(n, smooth, 2).alias(n))
    panel = panel.withColumn(value, F.when(F.col(n) >= least, F.col(value)))
    rows = _windowed(catalogue, panel, first, last, [value, n], span)
    x, w = F.col(value), F.col(n).cast("double")
    valid = F.count(x) > 0
    if kind == "mean":
        aggs = [F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))), F.when(valid, F.sum(w)).otherwise(0.0)]
    else:
        low = kind == "min" or compat_argmin
        pair = F.struct(x.alias("x"), w.alias("w"))
        best = F.min_by(pair, F.when(x.isNotNull(), F.struct(x, F.col("day")))) if low else F.max_by(pair, F.when(x.isNotNull(), F.struct(x, -F.unix_date("day"))))
        aggs = [best["x"], F.coalesce(best["w"], F.lit(0.0))]
    name = column_name(var, kind, first, last, True, smooth)
    count = column_name(var, kind, first, last, True, smooth, "n")
    out = rows.groupBy("px", "start").agg(aggs[0].alias(name), aggs[1].alias(count))
    return catalogue.join(out, ["px", "start"], "left").withColumn(count, F.coalesce(F.col(f"`{count}`"), F.lit(0.0)))
