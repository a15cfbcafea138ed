"""Clusters of events that are near in space and overlap or adjoin in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.panel import discarded, materialised

BUCKET_DAYS = 64


def links(events: DataFrame, reach: int = 7, key: str = "key") -> DataFrame:
    """a, b (a > b) of events with row, col, start and end (not included) that touch.

    Each event lies in its space bucket and in every time bucket that it meets; the other side is spread over the nine
    neighbouring space buckets, so the range join is an equi-join on small buckets.
    """
    size = reach + 1
    rows = events.select(F.col(key).alias("k"), "row", "col", F.datediff("start", F.lit("1970-01-01").cast("date")).alias("s"), F.datediff("end", F.lit("1970-01-01").cast("date")).alias("e"))
    spans = F.explode(F.sequence(F.floor(F.col("s") / BUCKET_DAYS), F.floor(F.col("e") / BUCKET_DAYS)))
    left = rows.withColumn("t", spans).withColumn("bi", F.floor(F.col("row") / size)).withColumn("bj", F.floor(F.col("col") / size))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)).cast("array<bigint>")
    right = rows.select(*[F.col(c).alias(f"{c}2") for c in ("k", "row", "col", "s", "e")]).withColumn("t", F.explode(F.sequence(F.floor(F.col("s2") / BUCKET_DAYS), F.floor(F.col("e2") / BUCKET_DAYS))))
    right = right.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near))
    right = right.withColumn("bi", F.floor(F.col("row2") / size) + F.col("di")).withColumn("bj", F.floor(F.col("col2") / size) + F.col("dj"))
    both = left.join(right, ["t", "bi", "bj"]).filter((F.col("k") > F.col("k2")) & (F.abs(F.col("row") - F.col("row2")) <= reach) & (F.abs(F.col("col") - F.col("col2")) <= reach) & (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")))
    return both.select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct()


def cluster(events: DataFrame, reach: int = 7, key: str = "key") -> DataFrame:
    """The events with cluster_id, the least key of the cluster.

    Labels spread along links and jump along labels until none changes. They only fall, and each round at least doubles how far
    the least one has come, so the rounds end; a round's labels are deleted once the next are written.
    """
    edges = materialised(links(events, reach, key), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = materialised(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(label, F.col("b") == F.col("k")).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, F.col("k") == F.col("a")).select("k", F.least("l", "m").alias("n"), F.col("l").alias("old"))
        # the label that a node's new label had before this round
        jump = step.join(label.select(F.col("k").alias("k2"), F.col("l").alias("l2")), F.col("n") == F.col("k2"), "left").select("k", F.least("n", F.coalesce("l2", "n")).alias("l"), "old")
        jump = materialised(jump, "labels")
        done = not jump.filter("l <> old").head(1)
        discarded(label)
        label = jump.select("k", "l")
        if done:
            break
    return events.join(label.select(F.col("k").alias(key), "l"), key, "left").withColumn("cluster_id", F.coalesce("l", key)).drop("l")


def add_clusters(catalogue: DataFrame, clusters: DataFrame) -> DataFrame:
    """Catalogue rows with the cluster of the event at (px, start)."""
    return catalogue.join(clusters.select("px", "start", "cluster_id"), ["px", "start"], "left")


def sizes(clusters: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """cluster, n: events of each cluster."""
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
