"""Onset-to-end events by threshold runs, the event catalogue and counts.

A start day has a prior mean above one limit and a coming minimum below another. From it, the event begins on the first
later day whose smoothed value is below the threshold and ends on the first day after that which is not (a missing value
ends it too). Short events are left out. All of it is running windows of a place, which share one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import centred_mean, centred_min, first_after, leading_min, onset, trailing_mean


@dataclass(frozen=True)
class Rule:
    """Fixed values of the standard rule; data of another kind needs others."""

    prior: float = -0.25
    after: float = -1.0
    below: float = -1.0
    min_days: int = 15
    frozen: float | None = 278.15


def features(panel: DataFrame, z: str = "z", temperature: str | None = "t", digits: int = 9, keep: tuple[str, ...] = ()) -> DataFrame:
    """px, day, p (5-day mean), b (30-day mean up to today), a (least p of the next 20 days), c (least 5-day temperature within 30 days)."""
    out = panel.select("px", "day", *keep, F.round(centred_mean(z, 5, 2), digits).alias("p"), F.round(trailing_mean(z, 30, 5), digits).alias("b"), (F.round(centred_mean(temperature, 5, 1), digits) if temperature else F.lit(None).cast("double")).alias("_tp"))
    return out.withColumn("a", leading_min("p", 20)).withColumn("c", centred_min("_tp", 61)).drop("_tp")


def is_start(rule: Rule) -> Column:
    cold = F.coalesce(F.col("c") < rule.frozen, F.lit(False)) if rule.frozen is not None else F.lit(False)
    return F.coalesce((F.col("b") > rule.prior) & (F.col("a") < rule.after), F.lit(False)) & ~cold


def intervals(feats: DataFrame, rule: Rule = Rule(), peak: DataFrame | None = None) -> DataFrame:
    """px, start, end of each event, end not included. With ``peak`` (px, peak_month) only events in the growing season stay."""
    low = F.coalesce(F.col("p") < rule.below, F.lit(False))
    before = Window.partitionBy("px").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag: F.max(F.when(flag, F.col("day"))).over(before)
    runs = feats.select("px", "day", low.alias("_low"), last(is_start(rule)).alias("_start"), last(low).alias("_seen"), first_after(~low).alias("over"))
    # the first low day after a start: no low day lies between the two, but the start may be one itself
    begun = runs.filter(F.col("_low") & F.coalesce(F.col("_start") >= F.col("_seen"), F.col("_start").isNotNull()))
    found = begun.filter(F.datediff("over", "day") >= rule.min_days).select("px", "day", "over")
    if peak is not None:
        apart = F.abs(F.month("day") - F.col("peak_month"))
        found = found.join(peak, "px").filter((apart <= 1) | (apart == 11))
    return found.groupBy("px", F.col("over").alias("end")).agg(F.min("day").alias("start")).select("px", "start", "end")


def mask(events: DataFrame) -> DataFrame:
    """px, day of every day of an event."""
    return events.select("px", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day")).distinct()


def catalogue(events: DataFrame, feats: DataFrame) -> DataFrame:
    """px, start, end, length and max_intensity, the least smoothed value of the event."""
    days = events.select("px", "start", "end", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day"))
    low = days.join(feats.select("px", "day", "p"), ["px", "day"]).groupBy("px", "start", "end").agg(F.min("p").alias("max_intensity"))
    return low.select("px", "start", "end", F.datediff("end", "start").alias("length"), "max_intensity")


def runs_of_mask(panel: DataFrame, flag: str = "flag") -> DataFrame:
    """px, start, end of the runs of any daily mask; a run that holds the first day has no onset and is left out, as is one without an end."""
    marked = panel.select("px", "day", onset(flag).alias("_on"), first_after(~F.coalesce(F.col(flag), F.lit(False))).alias("end"))
    return marked.filter("_on and end is not null").select("px", F.col("day").alias("start"), "end")


def onset_counts(events: DataFrame, places: DataFrame) -> DataFrame:
    """px, n_events for every place; NULL without events."""
    return places.join(events.groupBy("px").agg(F.count(F.lit(1)).alias("n_events")), "px", "left").select("px", "n_events")


def places_with_events(events: DataFrame, places: DataFrame, any_event: bool = True) -> DataFrame:
    """Places that have an event, or those that have none."""
    return places.join(events.select("px").distinct(), "px", "left_semi" if any_event else "left_anti")


def peak_month(panel: DataFrame, col: str) -> DataFrame:
    """px, peak_month: the month of the greatest mean, the first of equal ones; places without values are left out."""
    monthly = panel.groupBy("px", F.month("day").alias("m")).agg(F.round(F.avg(col), 9).alias("v")).filter("v is not null")
    return monthly.groupBy("px").agg(F.max_by("m", F.struct("v", -F.col("m"))).cast("int").alias("peak_month"))
