"""Linear-interpolation percentiles and right-closed quartiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.panel import materialised

#: Percentiles of an export.
LEVELS = [0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]


def quartile_of(value: Column, edges: Column) -> Column:
    """1 + the number of the three edges strictly below the value; NULL for NULL."""
    above = [F.when(value > F.element_at(edges, i), 1).otherwise(0) for i in (1, 2, 3)]
    return F.when(value.isNotNull(), (F.lit(1) + above[0] + above[1] + above[2]).cast("int"))


def exact_percentiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Linear-interpolation percentiles of all values that are not NULL; None without values.

    Equal values are counted first, then distinct ones are sorted by ranges; the driver gets a count for each range and the values at the
    ranks it needs. No task holds more than a range of distinct values, however often one value occurs.
    """
    counted = df.select(F.col(col).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    table = materialised(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "sorted")
    parts = sorted(tuple(r) for r in table.groupBy("part").agg(F.sum("n")).collect())  # a row for each range
    total = sum(n for _, n in parts)
    if not total:
        return [None] * len(shares)
    ranks = sorted({f(s * (total - 1)) for s in shares for f in (math.floor, math.ceil)})
    within, before = [], 0
    for part, n in parts:
        within += [(part, k - before) for k in ranks if before <= k < before + n]
        before += n
    order = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = table.filter(F.col("part").isin(sorted({p for p, _ in within}))).withColumn("upto", F.sum("n").over(order))
    hit = [(F.col("part") == p) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k) for p, k in within]
    found = {}
    for r in rows.withColumn("hits", F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)]))).filter(F.size("hits") > 0).select("v", "hits").collect():  # two for each share at most
        found |= {ranks[i]: r["v"] for i in r["hits"]}
    out = []
    for s in shares:
        at = s * (total - 1)
        lo, hi = math.floor(at), math.ceil(at)
        out.append(found[lo] if lo == hi else (hi - at) * found[lo] + (at - lo) * found[hi])
    return out


def with_quartile(df: DataFrame, col: str, name: str = "quartile") -> DataFrame:
    """Adds the quartile of ``col`` among all rows. The three edges are found when this is called."""
    edges = exact_percentiles(df, col, [0.25, 0.5, 0.75])
    return df.withColumn(name, quartile_of(F.col(col), F.array(*[F.lit(e).cast("double") for e in edges])))


def percentile_table(df: DataFrame, col: str, levels: list[int] | None = None) -> DataFrame:
    """percentile, value rows."""
    levels = levels or LEVELS
    values = exact_percentiles(df, col, [x / 100 for x in levels])
    return df.sparkSession.createDataFrame(list(zip(levels, values, strict=True)), "percentile int, value double")
