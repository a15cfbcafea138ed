"""Running sums in two levels: no task holds a group, only a range of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.panel import materialised


def with_before(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Adds, for each of ``cols``, ``<col>_before`` (its sum over the group's rows of smaller ``order``) and ``<col>_total`` (over all of them).

    A group has one row for each ``order``. Rows are dealt in ranges of group and order; sums run within a range, and then over
    the ranges of each group, of which there are no more than partitions.
    """
    rows = materialised(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    groups = by or [F.lit(0)]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within, ranges = upto(Window.partitionBy(*by, "_part").orderBy(order)), Window.partitionBy(*groups)
    parts = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in cols])
    parts = parts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(c).over(upto(ranges.orderBy("_part"))), F.lit(0)).alias(f"_base_{c}") for c in cols], *[F.sum(c).over(ranges).alias(f"{c}_total") for c in cols])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    out = rows.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in cols}).join(parts, same)
    out = out.withColumns({f"{c}_before": F.col(f"_in_{c}") + F.col(f"_base_{c}") for c in cols})
    return out.select(*df.columns, *[f"{c}_{k}" for c in cols for k in ("before", "total")])
