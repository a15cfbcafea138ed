"""Climatologies that years are added to: count, mean and squared distance of each place and calendar day, by year and by turn of the year.

The pool of a calendar day has the values up to ``half`` days around it. Those of its own year belong to the year's part, and those
across a turn of the year to the turn's part, which needs the days next to it alone. A year is added by its own part and the turns to its
neighbours; no older year is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anomaly import LEAST_STD

PART = "px int, md string, n bigint, mean double, m2 double"


def year_parts(panel: DataFrame, value: str, half: int = 3) -> DataFrame:
    """px, md, n, mean, m2, year: the parts of the years of a panel of gap-free days, each year by itself."""
    near = Window.partitionBy("px", "year").orderBy("day").rowsBetween(-half, half)
    rows = panel.select("px", "day", F.col(value).alias("_v")).withColumn("year", F.year("day"))
    out = rows.withColumns({"n": F.count("_v").over(near), "mean": F.avg("_v").over(near), "_var": F.var_pop("_v").over(near)})
    return out.filter("n > 0").select("px", F.date_format("day", "MM-dd").alias("md"), "n", "mean", (F.col("_var") * F.col("n")).alias("m2"), "year")


def near_turns(day: Column, half: int = 3) -> Column:
    """Days that turns of the year need."""
    return F.year(F.date_add(day, half)) + F.year(F.date_sub(day, half)) != 2 * F.year(day)


def turn_parts(panel: DataFrame, value: str, half: int = 3) -> DataFrame:
    """px, md, n, mean, m2, year: the parts of the turns to ``year`` from the year before, where the panel has both; the days of ``near_turns`` are enough."""
    rows = panel.filter(near_turns(F.col("day"), half)).select("px", "day", F.col(value).alias("_v"), F.year(F.date_add("day", half)).alias("year"))
    other = rows.filter("_v is not null").select("px", "year", F.col("day").alias("_b"), "_v")
    pairs = rows.select("px", "year", "day").join(other, ["px", "year"]).filter((F.year("day") != F.year("_b")) & (F.abs(F.datediff("day", "_b")) <= half))
    n = F.count(F.lit(1))
    return pairs.groupBy("px", F.date_format("day", "MM-dd").alias("md"), "year").agg(n.alias("n"), F.avg("_v").alias("mean"), (F.var_pop("_v") * n).alias("m2")).select("px", "md", "n", "mean", "m2", "year")


def merged(parts: DataFrame) -> DataFrame:
    """px, md, clim_mean, clim_std (population; NULL where it is zero) of all parts together; a calendar day has two parts a year at most."""
    held = parts.groupBy("px", "md").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.array_sort(F.collect_list(F.struct("year", "n", "mean", "m2"))).alias("each"))
    held = held.withColumn("clim_mean", F.col("s") / F.col("n"))
    apart = F.aggregate("each", F.lit(0.0), lambda acc, x: acc + x["m2"] + x["n"] * (x["mean"] - F.col("clim_mean")) * (x["mean"] - F.col("clim_mean")))
    std = F.sqrt(apart / F.col("n"))
    return held.select("px", "md", "clim_mean", F.when(std > LEAST_STD, std).alias("clim_std"))
