"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, written

ROWS_A_FILE = 200_000
LEAST_FILES = 24


def _place(df: DataFrame) -> str | None:
    files = df.inputFiles()
    return files[0].rpartition("/")[0] if files else None


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Large-star hangs each larger neighbour of a node on the smallest node around it, small-star each smaller one; after a
    few alternations each component is one star, which shows in that no node with a smaller neighbour has another. Minima
    are made with map-side sums and written, so that the join with the edges can split a hub's. Self-loops and repeated
    edges don't matter; null ends are left out. The number of edges never grows, so it sets the number of files. Each
    alternation lowers the sum of the edges' ends until the stars are there, so the loop ends; tables of past rounds are deleted.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    edges = written(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    files = max(LEAST_FILES, edges.count() // ROWS_A_FILE)

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df.coalesce(files), name)

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "star")
        if not least.filter("m < u and n > 1").head(1):
            break
        past = [_place(edges), _place(least)]
        least = least.select("u", F.least("u", "m").alias("m"))
        edges = kept(both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "edges")
        least = kept(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "star")
        past += [_place(edges), _place(least)]
        hung = edges.join(least, F.col("a") == F.col("u"))
        edges = kept(hung.select("a", F.col("m").alias("b")).unionByName(hung.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        for path in filter(None, past):
            removed(spark, path)
    # every node of the stars, with the smaller of itself and its least neighbour
    return least.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
