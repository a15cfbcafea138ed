"""Annual land cover, nearest in time, and filters by class group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import nearest_stamp_year
from ..functions.grid import coarse_class
from ..registry import TOP_LAND_COVERS, members


def class_of_day(rows: DataFrame, land_cover: DataFrame, day: str = "day", first: int | None = None, last: int | None = None) -> DataFrame:
    """Adds ``class`` of the nearest year (2 July stamps); years before the first or after the last use that one."""
    if first is None or last is None:
        first, last = land_cover.agg(F.min("year"), F.max("year")).first()
    keyed = rows.withColumn("_y", nearest_stamp_year(F.col(day), first, last))
    cover = land_cover.select("px", F.col("year").alias("_y"), "class")
    return keyed.join(cover, ["px", "_y"], "left").drop("_y")


#: Classes that a legend has at most.
MOST_CLASSES = 10_000


def legend(key: DataFrame) -> dict[str, int]:
    """Codes by class name; ValueError where the table is no legend of MOST_CLASSES rows at most, so that no unbounded table comes to the driver."""
    rows = key.select("land_cover", "flag").limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} land-cover classes")
    return {r["land_cover"]: r["flag"] for r in rows}


def flags_of(key: DataFrame, group: str) -> list[int]:
    """Codes of a group by the key table (one row a class); an unknown class raises KeyError."""
    found = legend(key)
    return [found[m] for m in members(group, list(found))]


def in_group(rows: DataFrame, land_cover: DataFrame, key: DataFrame, group: str, day: str = "day", **span) -> DataFrame:
    """Rows whose class on that day belongs to the group; the group ``all`` keeps every row."""
    if group == "all":
        return rows
    return class_of_day(rows, land_cover, day, **span).filter(F.col("class").isin(flags_of(key, group))).drop("class")


def group_name(code: Column, key: DataFrame, groups: list[str] = TOP_LAND_COVERS) -> Column:
    """Name of the group that a code belongs to; NULL outside of all."""
    flags = legend(key)
    out = F.lit(None).cast("string")
    for g in reversed([g for g in groups if set(members(g)) & set(flags)]):
        out = F.when(code.isin([flags[m] for m in members(g) if m in flags]), F.lit(g)).otherwise(out)
    return out


def top_map(land_cover: DataFrame, year: int, codes: list[int], event_places: DataFrame) -> DataFrame:
    """px, coarse: the coarse class where it is one of ``codes`` and the place has events, else 0."""
    one = land_cover.filter(F.col("year") == year).select("px", coarse_class(F.col("class")).alias("c"))
    marked = one.join(event_places.select("px").distinct().withColumn("_e", F.lit(1)), "px", "left")
    return marked.select("px", F.when(F.col("_e").isNotNull() & F.col("c").isin(codes), F.col("c")).otherwise(0).cast("int").alias("coarse"))
