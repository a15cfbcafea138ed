"""Whole jobs by the registry: raw values of a variable to yearly anomaly tables, and composites of many variables in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.grid import RESOLUTION, SOUTH, WEST
from ..functions.quartiles import with_quartile
from ..operators import anomaly, landcover
from ..operators.composite import composite
from ..registry import TOP_LAND_COVERS, Variable, variable
from ..sources import ingest
from .panel import densify


def centre(index: Column, first: float, step: float) -> Column:
    """Coordinate of a cell's centre."""
    return F.lit(first + step / 2) + index * F.lit(step)


def variable_panel(raw: DataFrame, rule: str | Variable, places: DataFrame, land: DataFrame | None = None, south: float = SOUTH, west: float = WEST, step: float = RESOLUTION, cols: int = 1440) -> DataFrame:
    """px, day, value on the gap-free calendar of a variable's years, from raw rows of ts, row, col and value.

    By the registry's entry (or one that is given): fill values, time shift, regridding to cell centres and the land mask where the entry asks for
    them, the crop, float32, and the entry's years. ``places`` has the px to keep; ``land`` has row, col and land_fraction.
    """
    rule = variable(rule) if isinstance(rule, str) else rule
    rows = ingest.filled(raw, rule).withColumn("day", F.to_date("ts")).filter(F.year("day").between(rule.first_year, rule.last_year)).select("day", "row", "col", "value")
    if rule.regrid:
        rows = ingest.half_cell_regrid(rows)
        if land is not None:
            rows = ingest.land_only(rows, land)
    rows = ingest.cropped(rows.withColumns({"lat": centre(F.col("row"), south, step), "lon": centre(F.col("col"), west, step)}))
    values = rows.select((F.col("row") * cols + F.col("col")).cast("int").alias("px"), "day", F.col("value").cast("float").cast("double").alias("value"))
    return densify(values, places, f"{rule.first_year}-01-01", f"{rule.last_year}-12-31")


def save_anomalies(raw: DataFrame, rule: str | Variable, places: DataFrame, path: str, **grid) -> bool:
    """Writes px, day, value and its standardised anomaly z by year, unless the table is there; says whether it did."""
    if ingest.exists(raw.sparkSession, path):
        return False
    ingest.write_years(anomaly.standardised(variable_panel(raw, rule, places, **grid), "value"), path, mode="overwrite")
    return True


def rolling_windows(panel: DataFrame, value: str = "v") -> DataFrame:
    """px, day and the five windows of a daily series: the centred 5-day mean and 61-day minimum, the mean of the 30 days up to a day, the least and the
    greatest value of days ahead. They share one exchange and sort."""
    return panel.select(
        "px", "day", frames.centred_mean(value, 5, 2).alias("mean_5d"), frames.centred_min(value, 61).alias("min_61d"), frames.trailing_mean(value, 30, 5).alias("mean_30d"),
        frames.leading_min(value, 20).alias("min_next_20d"), frames.leading_max(value, 20, 2).alias("max_20d"),
    )


def save_rolling(panel: DataFrame, path: str, value: str = "v") -> bool:
    """Writes the five windows by year, in one pass, unless the table is there; says whether it did."""
    if ingest.exists(panel.sparkSession, path):
        return False
    ingest.write_years(rolling_windows(panel, value), path, mode="overwrite")
    return True


def stacked(panels: dict[str, DataFrame], value: str = "z", weight: str | None = None) -> DataFrame:
    """variable, px, day, value (and weight) of several panels, as one."""
    cols = [F.col(value).alias("value"), *([F.col(weight).alias("weight")] if weight else [])]
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("variable"), "px", "day", *cols) for name, p in panels.items()])


def all_composites(events: DataFrame, panels: DataFrame, cover: DataFrame, key: DataFrame, lags: int = 240, groups: list[str] = TOP_LAND_COVERS, quartiles: str | None = None, weight: str | None = None, least: float | None = None, **span) -> DataFrame:
    """Composites of every variable of ``panels`` (as ``stacked`` gives them) by land-cover group, and by quartile of an events' column, in one pass.

    variable, land_cover, quartile (where asked for), lag and the columns of ``composite``.
    """
    rows = landcover.class_of_day(events, cover, "start", **span)
    rows = rows.withColumn("land_cover", landcover.group_name(F.col("class"), key, groups)).filter("land_cover is not null")
    by = ["land_cover"]
    if quartiles:
        rows = with_quartile(rows, quartiles).filter("quartile is not null")
        by.append("quartile")
    return composite(rows, panels, "value", lags, by=by, across=["variable"], weight=weight, least=least)
