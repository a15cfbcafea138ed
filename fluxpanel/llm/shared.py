"""Tables and files in the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a session with master ``local``
(tests, one machine) gets a temporary folder; on a cluster that is an error, since a machine's own folder is lost with it.
Every intermediate table goes there, so that a lost executor costs the tasks that ran on it and nothing else.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end; RuntimeError where a cluster's session names none."""
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


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that is no longer read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a path of the shared folder is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def open_fs(uri: str):
    """(file system, path) for a shared path, on the driver or in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, data: bytes) -> None:
    """Writes a whole file: under another name first, so that a second attempt of a task never shows half a file.

    A name stands for its bytes: where an earlier attempt has put the file there already, that one stays.
    """
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    try:
        system.move(part, path)
    except OSError:  # some file systems refuse to move onto a file
        if not system.get_file_info(path).is_file:
            raise
        system.delete_file(part)


@contextmanager
def streamed(uri: str) -> Iterator:
    """An output stream to a file whose name no other attempt uses; what is written is not kept in memory."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


def get(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    """A file's bytes, or a range of them."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as src:
        if offset:
            src.seek(offset)
        return src.read() if length is None else src.read(length)


def bounded_sample(df: DataFrame, size: int, order: Column, total: int) -> DataFrame:
    """The ``size`` rows of smallest ``order``, a 64-bit number. Rows are counted by its upper 16 bits first (65,536 counts at most), so that only
    about ``size`` rows take part in the sort, however the numbers are spread."""
    if total > 2 * size:
        upper = F.shiftright(order, 48)
        taken, last = 0, None
        for part, n in sorted(tuple(r) for r in df.groupBy(upper.alias("part")).count().collect()):
            taken, last = taken + n, part
            if taken >= size:
                break
        df = df.filter(upper <= F.lit(last))
    return df.withColumn("_order", order).orderBy("_order", *df.columns).limit(size).drop("_order")


def broadcast_value(spark: SparkSession, value):
    """A driver-side model of bounded size for the tasks."""
    return spark.sparkContext.broadcast(value)


def before_each(df: DataFrame, order: str, value: str, name: str = "before", group: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``order``, a whole number from 0 that no two rows share.

    Sums within runs of ``group`` numbers, then over the runs: no task holds more than a run, or one row a run.
    """
    run = F.expr(f"`{order}` div {group}")
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_run", run)
    runs = rows.groupBy("_run").agg(F.sum(value).alias("_sum")).withColumn("_far", F.expr(f"_run div {group}"))
    far = runs.groupBy("_far").agg(F.sum("_sum").alias("_all"))
    far = far.select("_far", F.coalesce(F.sum("_all").over(upto(F.lit(0)).orderBy("_far")), F.lit(0)).alias("_base"))
    runs = runs.withColumn("_near", F.coalesce(F.sum("_sum").over(upto("_far").orderBy("_run")), F.lit(0))).join(far, "_far").select("_run", (F.col("_near") + F.col("_base")).alias("_start"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(upto("_run").orderBy(order)), F.lit(0))).join(runs, "_run")
    return rows.withColumn(name, F.col("_start") + F.col("_in")).drop("_run", "_in", "_start")
