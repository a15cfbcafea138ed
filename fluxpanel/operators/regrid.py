"""Linear interpolation between any two rectangular grids, as a sparse join with one table of weights for each axis."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "source int, target int, weight double"


def weights(source: list[float], target: list[float]) -> list[tuple[int, int, float]]:
    """(source index, target index, weight) of each target coordinate: one row where it is a source coordinate, else two; none beyond the ends.

    Both may ascend or descend. ValueError for repeated or unordered source coordinates.
    """
    order = sorted(range(len(source)), key=lambda i: source[i])
    if order not in (list(range(len(source))), list(range(len(source)))[::-1]) or len(set(source)) < len(source):
        raise ValueError("source coordinates must ascend or descend")
    up = [source[i] for i in order]
    out = []
    for k, x in enumerate(target):
        j = bisect_right(up, x) - 1
        if j < 0 or x > up[-1]:
            continue
        if up[j] == x:
            out.append((order[j], k, 1.0))
        else:
            share = (x - up[j]) / (up[j + 1] - up[j])
            out += [(order[j], k, 1.0 - share), (order[j + 1], k, share)]
    return out


def axis(spark: SparkSession, source: list[float], target: list[float]) -> DataFrame:
    """The weights of one axis: two rows a target coordinate at most."""
    return spark.createDataFrame(weights(source, target), WEIGHTS)


def regridded(df: DataFrame, rows: DataFrame, cols: DataFrame, value: str = "value", keys: tuple[str, ...] = ("day",), row: str = "row", col: str = "col") -> DataFrame:
    """keys, row, col, value on the target grid; a target cell with a missing source cell is NULL, one with none is absent.

    ``rows`` and ``cols`` are weights of the two axes (``axis``). A cell goes to the targets it has a weight in, and those are summed.
    """
    at = rows.select(F.col("source").alias(row), F.col("target").alias("_r"), F.col("weight").alias("_wr"))
    by = cols.select(F.col("source").alias(col), F.col("target").alias("_c"), F.col("weight").alias("_wc"))
    # how many source cells each target cell has: the product of two small counts
    count = lambda w, name: w.groupBy("target").agg(F.count(F.lit(1)).alias(name))
    spread = df.join(at, row).join(by, col).select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), (F.col(value) * F.col("_wr") * F.col("_wc")).alias("_v"))
    out = spread.groupBy(*keys, row, col).agg(F.sum("_v").alias("_v"), F.count("_v").alias("_n"))
    out = out.join(count(rows, "_k").withColumnRenamed("target", row), row).join(count(cols, "_l").withColumnRenamed("target", col), col)
    return out.select(*keys, row, col, F.when(F.col("_n") == F.col("_k") * F.col("_l"), F.col("_v")).alias(value))
