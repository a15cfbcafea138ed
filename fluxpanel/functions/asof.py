"""Nearest row in time, in both directions, over stamps at any distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_nearest(rows: DataFrame, stamps: DataFrame, on: list[str], at: str, stamp: str, cols: list[str]) -> DataFrame:
    """The rows with ``cols`` of the stamp of their keys that is nearest to ``at``: of two as near, the earlier.

    Rows and stamps go through one exchange by key; the last stamp up to a row and the first one from it on are running values, so no row meets
    more than two stamps. Of stamps of one key and time, the greatest ``cols`` count. A row without a key, a time or stamps has NULL; stamps
    without a key or time are left out.
    """
    kinds = dict(rows.dtypes)
    kept = [c for c in rows.columns if c not in cols]
    held = stamps.filter(F.col(stamp).isNotNull()).groupBy(*on, F.col(stamp).alias("_t")).agg(F.max(F.struct(*cols)).alias("_s"))
    held = held.select(*on, *[F.lit(None).cast(kinds[c]).alias(c) for c in kept if c not in on], F.col("_t").cast("timestamp"), F.struct(F.col("_t").cast("timestamp").alias("t"), "_s").alias("_x"), F.lit(False).alias("_row"))
    mine = rows.select(*on, *[c for c in kept if c not in on], F.col(at).cast("timestamp").alias("_t"), F.lit(None).cast(dict(held.dtypes)["_x"]).alias("_x"), F.lit(True).alias("_row"))
    both = held.unionByName(mine)
    # stamps before rows of their time in either order; the second order is reversed, so that its frame grows row by row as well
    last = lambda *order: F.last("_x", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_before", last(F.col("_t"), F.col("_row"))).withColumn("_after", last(F.col("_t").desc(), F.col("_row"))).filter("_row")
    away = lambda c: F.abs(F.unix_micros("_t") - F.unix_micros(F.col(f"{c}.t")))
    near = F.when(F.col("_t").isNull(), None).when(F.col("_after").isNull() | (away("_before") <= away("_after")), F.col("_before")).otherwise(F.col("_after"))
    keyed = F.lit(True)
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    out = both.withColumn("_near", F.when(keyed, near))
    return out.select(*kept, *[F.col(f"_near._s.{c}").alias(c) for c in cols])
