"""Panels: one row for each place and day of a gap-free calendar."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First and last day of the calendar of the order panel.
FIRST, LAST = "1995-01-01", "2001-11-04"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir; a temporary one on a single machine, else RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fluxpanel-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/fluxpanel/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written once as a Parquet table in the shared folder and read back, for plans that read them more than once: each reads only its columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a materialised table that is no longer read."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def nulls(df: DataFrame, *cols: str) -> DataFrame:
    """NaN is missing: NULL from here on."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def densify(values: DataFrame, places: DataFrame, first: str, last: str, px: str = "px", day: str = "day") -> DataFrame:
    """Every place on every day, with the values there are. The calendar is made by each place's row, not by a join."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day")))
    return places.select(px).withColumn(day, days).join(values, [px, day], "left")


def common_span(*frames: DataFrame, day: str = "day") -> tuple:
    """Latest first day and earliest last day of several panels; one row of each comes to the driver."""
    ends = [f.agg(F.min(day), F.max(day)).first() for f in frames]
    return max(e[0] for e in ends), min(e[1] for e in ends)


def clipped(*frames: DataFrame, day: str = "day") -> list[DataFrame]:
    """The panels within their common span, both ends included."""
    lo, hi = common_span(*frames, day=day)
    return [f.filter(F.col(day).between(F.lit(lo), F.lit(hi))) for f in frames]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, day, v, n, u: mean quantity, number of lines and mean price by nation and shipping day."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("px"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    means = rows.groupBy("px", "day").agg(F.avg("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("u"))
    return means


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, day, v, n, u and t, a temperature made of u, on the whole calendar."""
    places = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("px"))
    out = densify(order_values(spark, sf_dir), places, FIRST, LAST)
    return out.withColumn("t", F.lit(275.15) + F.col("u") / F.lit(7001.3))
