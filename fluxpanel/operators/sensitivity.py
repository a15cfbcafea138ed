"""Change of a variable over change of soil moisture around events, by coarse box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import roll
from .composite import aligned


def sensitivity(events: DataFrame, panel: DataFrame, moisture: str, var: str, by: list[str], lags: int = 60, before: tuple[int, int] = (-60, -30), least: float = 100, increases: bool = False, smooth: int = 5) -> DataFrame:
    """by, sensitivity, n.

    Composites of both variables by box and lag; means and counts smoothed over lags. A box needs more than ``least``
    observations before the onset and some smoothed count above it from the onset on, for both. Before: mean of the
    unsmoothed composite; after: least smoothed moisture, and least (or, if it increases, greatest) smoothed variable, of the
    lags whose smoothed count reaches ``least``. n is the variable's smoothed count at that lag, the first of equal ones.
    """
    rows = aligned(events, panel, lags, [moisture, var], by)
    comp = rows.groupBy(*by, "lag").agg(F.avg(moisture).alias("m"), F.count(moisture).alias("mn"), F.avg(var).alias("x"), F.count(var).alias("xn"))
    lo, hi = -(smooth // 2), smooth // 2
    over = lambda c, fn: roll(c, fn, lo, hi, 1, tuple(by), "lag")
    comp = comp.select(*by, "lag", "m", "mn", "x", "xn", over("m", F.avg).alias("ms"), over("mn", F.sum).alias("mns"), over("x", F.avg).alias("xs"), over("xn", F.sum).alias("xns"))
    base = F.col("lag").between(*before)
    after = F.col("lag") >= 0
    m_ok = F.when(after & (F.col("mns") >= least), F.col("ms"))
    x_ok = F.when(after & (F.col("xns") >= least), F.col("xs"))
    key = F.when(x_ok.isNotNull(), F.struct(-x_ok if increases else x_ok, F.col("lag")))
    box = comp.groupBy(*by).agg(F.sum(F.when(base, F.col("mn"))).alias("mb_n"), F.sum(F.when(base, F.col("xn"))).alias("xb_n"), F.max(F.when(after, F.col("mns"))).alias("ma_n"), F.max(F.when(after, F.col("xns"))).alias("xa_n"), F.avg(F.when(base, F.col("m"))).alias("mb"), F.avg(F.when(base, F.col("x"))).alias("xb"), F.min(m_ok).alias("ma"), (F.max if increases else F.min)(x_ok).alias("xa"), F.min_by("xns", key).alias("n"))
    enough = (F.col("mb_n") > least) & (F.col("xb_n") > least) & (F.col("ma_n") > least) & (F.col("xa_n") > least)
    ratio = F.try_divide(F.col("xa") - F.col("xb"), F.col("ma") - F.col("mb"))
    return box.select(*by, F.when(enough, ratio).alias("sensitivity"), F.when(enough, F.col("n")).alias("n"))


def on_grid(result: DataFrame, rows: int, cols: int, i: str = "box_i", j: str = "box_j") -> DataFrame:
    """One row for every box of the map, missing ones too."""
    spark = result.sparkSession
    grid = spark.range(rows).select(F.col("id").cast("int").alias(i), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias(j))
    return grid.join(result, [i, j], "left")
