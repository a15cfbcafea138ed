"""Exceedance, kernel density, histogram, Mann-Whitney and a seeded cluster bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import with_before
from ..functions.quartiles import with_quartile
from ..plans.panel import materialised


def exceedance(df: DataFrame, value: str, quartile_by: str, threshold: float) -> DataFrame:
    """quartile, n_above, n_total, percent of rows above the threshold."""
    rows = with_quartile(df.dropna(subset=[value, quartile_by]), quartile_by)
    out = rows.groupBy("quartile").agg(F.sum((F.col(value) > threshold).cast("bigint")).alias("n_above"), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("percent", F.col("n_above") * 100.0 / F.col("n_total"))


def density(df: DataFrame, value: str, by: str, low: float, high: float, points: int = 100) -> DataFrame:
    """by, x, density: Gaussian kernels with Scott's bandwidth in each group, scaled by the group's share of all rows."""
    # equal values count once, with their number
    rows = df.dropna(subset=[value, by]).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    shape = df.dropna(subset=[value, by]).groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_s"))
    shape = shape.withColumn("_total", F.sum("_n").over(Window.partitionBy())).withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    step = (high - low) / (points - 1)
    grid = rows.join(shape, by).filter("_h > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(low) + F.col("i") * F.lit(step))
    z = (F.col("x") - F.col("_v")) / F.col("_h")
    one = F.col("_k") * F.exp(-0.5 * z * z) / (F.col("_h") * math.sqrt(2 * math.pi) * F.col("_total"))
    return grid.groupBy(by, "i", "x").agg(F.sum(one).alias("density")).drop("i")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n: equal bins from the least to the greatest value, the last one closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.select(F.col(value).alias("_v")).filter("_v is not null").crossJoin(F.broadcast(ends))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(bins - 1))
    return rows.groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def mann_whitney(df: DataFrame, value: str, group: str, first, second, by: list[str] | None = None) -> DataFrame:
    """u, p, n1, n2 by groups: U of ``first`` against ``second`` with ties counted half, and p = U / (n1 n2)."""
    by = by or []
    rows = df.filter(F.col(group).isin([first, second]) & F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), (F.col(group) == first).alias("_a"))
    # equal values are counted first, so a running sum over distinct values replaces ranks of rows; it runs over ranges of values
    counts = rows.groupBy(*by, "_v").agg(F.sum(F.col("_a").cast("bigint")).alias("a"), F.sum((~F.col("_a")).cast("bigint")).alias("b"))
    won = with_before(counts, by, "_v", ["b"]).withColumn("w", F.col("a") * (F.col("b_before") + F.col("b") * 0.5))
    out = won.groupBy(*by).agg(F.sum("w").alias("u"), F.coalesce(F.sum("a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("b"), F.lit(0)).alias("n2"))
    return out.withColumn("p", F.try_divide(F.col("u"), (F.col("n1") * F.col("n2")).cast("double")))


def draw(iteration: Column, slot: Column, clusters: int) -> Column:
    """A cluster number from 0 for each iteration and slot: the first fifteen hex digits of a digest, modulo the count."""
    text = F.concat_ws("-", iteration.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(clusters)


def bootstrap(df: DataFrame, value: str, quartile_by: str, cluster: str, iterations: int = 1000, least_clusters: int = 10, reverse: bool = False) -> DataFrame:
    """iter, p: in each iteration clusters are drawn with replacement, all their rows taken, quartiles cut anew, and p = U(Q1 against Q4) / (n1 n4).

    ``reverse`` gives 1 - p. Equal rows are counted, not repeated: draws of one cluster in one iteration become a weight. Each cluster's number is a
    slot that draws in every iteration, so draws are made where the clusters lie; ranks and quartile edges are running sums over
    ranges of (iteration, value), so no task holds an iteration.
    """
    rows = materialised(df.dropna(subset=[value, quartile_by]).groupBy(F.col(cluster).alias("_c"), F.col(value).alias("_v"), F.col(quartile_by).alias("_q")).agg(F.count(F.lit(1)).alias("_n")), "bootstrap")
    clusters, n = numbered(rows.select("_c").distinct(), "_c", "_k")
    if n < least_clusters:
        raise ValueError(f"{n} clusters; {least_clusters} are needed")
    draws = clusters.select(F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter"), F.col("_k").alias("slot"))
    draws = draws.withColumn("_k", draw(F.col("iter"), F.col("slot"), n)).groupBy("iter", "_k").agg(F.count(F.lit(1)).alias("times"))
    taken = materialised(draws.join(clusters, "_k").join(rows, "_c").select("iter", "_v", "_q", (F.col("times") * F.col("_n")).alias("times")), "taken")
    # quartile edges: the rows that hold the ranks on both sides of an edge
    placed = with_before(taken.groupBy("iter", "_q").agg(F.sum("times").alias("w")), ["iter"], "_q", ["w"])
    at = {share: F.lit(share) * (F.col("w_total") - 1) for share in (0.25, 0.75)}
    holds = lambda k: F.max(F.when((F.col("w_before") <= k) & (k < F.col("w_before") + F.col("w")), F.col("_q")))
    edges = placed.groupBy("iter").agg(*[holds(fn(x)).alias(f"{side}{i}") for i, x in enumerate(at.values()) for side, fn in (("lo", F.floor), ("hi", F.ceil))], *[F.max(x).alias(f"at{i}") for i, x in enumerate(at.values())])
    between = lambda i: F.when(F.floor(f"at{i}") == F.ceil(f"at{i}"), F.col(f"lo{i}")).otherwise((F.ceil(f"at{i}") - F.col(f"at{i}")) * F.col(f"lo{i}") + (F.col(f"at{i}") - F.floor(f"at{i}")) * F.col(f"hi{i}"))
    edges = edges.select(F.col("iter").alias("_i"), between(0).alias("_e1"), between(1).alias("_e3"))  # a row for each iteration
    cut = taken.join(edges, F.col("iter") == F.col("_i")).filter((F.col("_q") <= F.col("_e1")) | (F.col("_q") > F.col("_e3")))
    low = F.col("_q") <= F.col("_e1")
    counts = cut.groupBy("iter", "_v").agg(F.sum(F.when(low, F.col("times")).otherwise(0)).alias("a"), F.sum(F.when(low, 0).otherwise(F.col("times"))).alias("b"))
    won = with_before(counts, ["iter"], "_v", ["b"]).withColumn("w", F.col("a") * (F.col("b_before") + F.col("b") * 0.5))
    p = F.try_divide(F.sum("w"), (F.sum("a") * F.sum("b")).cast("double"))
    return won.groupBy("iter").agg((1 - p if reverse else p).alias("p"))


def numbered(ids: DataFrame, col: str, name: str) -> tuple[DataFrame, int]:
    """(the distinct ids with their number from 0 in ascending order, how many there are): numbered within ranges, then moved by the ranges before."""
    table = materialised(ids.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), "numbered")
    within = table.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1)
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in table.groupBy("_part").count().collect()):  # a row for each range
        before.append((part, total))
        total += n
    moved = df_of(ids, before)
    return within.join(moved, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"), total


def df_of(like: DataFrame, before: list[tuple[int, int]]) -> DataFrame:
    """_part, _before rows."""
    return like.sparkSession.createDataFrame(before, "_part int, _before bigint")


def observed(df: DataFrame, value: str, quartile_by: str, reverse: bool = False) -> DataFrame:
    """u, p, n1, n2 on the rows as they are."""
    rows = with_quartile(df.dropna(subset=[value, quartile_by]), quartile_by)
    out = mann_whitney(rows, value, "quartile", 1, 4)
    return out.withColumn("p", 1 - F.col("p")) if reverse else out


def bound(samples: DataFrame, level: float = 0.05) -> DataFrame:
    """One-sided bound: a low percentile of the bootstrap's p."""
    return samples.agg(F.percentile("p", F.lit(level)).alias("bound"), F.count("p").alias("n"))


def cluster_summary(df: DataFrame, value: str, quartile_by: str, cluster: str) -> DataFrame:
    """n_clusters, n_events, largest: what a bootstrap over the clusters has to draw from."""
    sizes = df.dropna(subset=[value, quartile_by]).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_events"), F.max("n").alias("largest"))
