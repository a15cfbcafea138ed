"""Panels that lie in buckets by place, so that windows, composites and lookups read them where they are.

A panel is written once into as many buckets as it is to have partitions, sorted by place and day. Whatever groups, orders or joins by place then needs no
exchange of it; the events that it meets are dealt into its buckets instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .panel import new_path

#: A join on place and day may use a distribution by place alone, and sort orders of buckets count.
NEEDED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@contextmanager
def bucket_joins(spark: SparkSession) -> Iterator[None]:
    """Plans made here may join buckets on more than their key; the settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in NEEDED}
    for k, v in NEEDED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(panel: DataFrame, buckets: int, name: str = "panel") -> DataFrame:
    """The panel as a table of its own name and path in the shared folder, in buckets by px, sorted by px and day; one file a bucket."""
    spark, table = panel.sparkSession, f"fluxpanel_{name}_{uuid.uuid4().hex}"
    dealt = panel.repartition(buckets, "px").sortWithinPartitions("px", "day")
    dealt.write.bucketBy(buckets, "px").sortBy("px", "day").option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)
