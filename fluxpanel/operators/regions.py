"""Catalogue rows by region and season, counts by cell, latitude bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import in_season
from ..registry import BANDS, REGIONS


def regional(catalogue: DataFrame, region: str | tuple[float, float, float, float], season: str | None = None, start: str = "start") -> DataFrame:
    """Events strictly inside (west, east, south, north) that start in the season's months."""
    west, east, south, north = REGIONS[region] if isinstance(region, str) else region
    out = catalogue.filter((F.col("lat") > south) & (F.col("lat") < north) & (F.col("lon") > west) & (F.col("lon") < east))
    return out.filter(in_season(F.col(start), season)) if season else out


def count_grid(catalogue: DataFrame) -> DataFrame:
    """lat, lon, n of events by cell."""
    return catalogue.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def banded(catalogue: DataFrame) -> DataFrame:
    """Adds band and band_order by latitude, for an export in band order."""
    lat, name, order = F.col("lat"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (band, low, high) in enumerate(BANDS):
        cond = (lat >= low if low is not None else F.lit(True)) & (lat < high if high is not None else F.lit(True))
        name, order = F.when(cond, band).otherwise(name), F.when(cond, i).otherwise(order)
    return catalogue.withColumns({"band": name, "band_order": order})
