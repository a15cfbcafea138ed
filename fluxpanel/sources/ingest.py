"""Ingest rules by variable, linear regridding to cell centres, tables and files."""

from __future__ import annotations

import io
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import rounded
from ..operators.regions import banded
from ..registry import LEAST_OBSERVATIONS, Variable
from .classic import open_fs


def filled(df: DataFrame, rule: Variable, value: str = "value", ts: str = "ts") -> DataFrame:
    """Fill values and NaN become NULL, times shift."""
    v = F.when(~F.isnan(value), F.col(value))
    if rule.below is not None:
        v = F.when(v < rule.below, v)
    if rule.above is not None:
        v = F.when(v > rule.above, v)
    shifted = F.col(ts) + F.expr(f"interval {rule.shift_hours} hours") if rule.shift_hours else F.col(ts)
    return df.withColumn(value, v).withColumn(ts, shifted)


def cropped(df: DataFrame, south: float = -60, north: float = 80, west: float = -180, east: float = 180) -> DataFrame:
    """Rows within the map, both ends included."""
    return df.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def apply_rule(df: DataFrame, rule: Variable, value: str = "value", ts: str = "ts", south: float = -60, north: float = 80, west: float = -180, east: float = 180) -> DataFrame:
    """Fill values become NULL, times shift, rows outside the map go (both ends in), values become float32, day is the date."""
    out = filled(cropped(df, south, north, west, east), rule, value, ts)
    return out.withColumn(value, F.col(value).cast("float")).withColumn("day", F.to_date(ts))


def half_cell_regrid(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ("day",), row: str = "row", col: str = "col") -> DataFrame:
    """Linear interpolation to the centres between four grid points: their mean; a missing corner, or one off the grid, gives no value."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, -1) for j in (0, -1)]))
    spread = df.withColumn("_c", corner).select(*keys, (F.col(row) + F.col("_c.i")).alias(row), (F.col(col) + F.col("_c.j")).alias(col), value)
    return spread.groupBy(*keys, row, col).agg(F.when(F.count(value) == 4, F.sum(value) / 4).alias(value), F.count(F.lit(1)).alias("_k")).filter("_k = 4").drop("_k")


def land_only(df: DataFrame, fraction: DataFrame, least: float = 0.5, value: str = "value", on: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Values where the land fraction reaches ``least``; NULL elsewhere. The mask is one row a cell of the map."""
    return df.join(fraction, list(on), "left").withColumn(value, F.when(F.col("land_fraction") >= least, F.col(value))).drop("land_fraction")


def valid_places(static: DataFrame) -> DataFrame:
    """Land that is not rainforest."""
    return static.filter((F.col("land") == 1) & (F.coalesce(F.col("rainforest"), F.lit(0)) == 0))


def least_count(df: DataFrame, value: str, n: str, least: float = LEAST_OBSERVATIONS, zero_counts: bool = False) -> DataFrame:
    """Values with fewer observations are missing; with ``zero_counts`` their count is 0."""
    ok = F.coalesce(F.col(n) >= least, F.lit(False))
    out = df.withColumn("_ok", ok).withColumn(value, F.when(F.col("_ok"), F.col(value)))
    return (out.withColumn(n, F.when(F.col("_ok"), F.col(n)).otherwise(0)) if zero_counts else out).drop("_ok")


def read_years(spark: SparkSession, path: str, first: int, last: int, columns: list[str]) -> DataFrame:
    """A year-partitioned table: only the years and columns asked for are read."""
    return spark.read.parquet(path).filter(F.col("year").between(first, last)).select(*columns)


def write_years(df: DataFrame, path: str, day: str = "day", mode: str = "errorifexists") -> None:
    """One partition a year, sorted by place and day; ``ignore`` leaves an existing table alone."""
    df.withColumn("year", F.year(day)).repartition("year", "px").sortWithinPartitions("px", day).write.mode(mode).partitionBy("year").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes the table unless it is there; says whether it did."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


#: Headings of a catalogue file.
HEADINGS = {"lat": "latitude (degrees north)", "lon": "longitude (degrees east)", "start": "start date", "end": "end date", "length": "length", "max_intensity": "maximum intensity"}
KINDS = {"lat": "double", "lon": "double", "start": "date", "end": "date", "length": "int", "max_intensity": "double"}


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file with its headings, under short names; any other columns, as enrichment adds them, are numbers under their own names."""
    short = {v: k for k, v in HEADINGS.items()}
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(f"`{c}`").cast(KINDS[short[c]] if c in short else "double").alias(short.get(c, c)) for c in rows.columns])


def write_catalogue_csv(df: DataFrame, path: str, bands: bool = False) -> None:
    """A catalogue with its headings and any further columns; with ``bands`` its files, read by name, list the rows by latitude band."""
    extra = [c for c in df.columns if c not in HEADINGS and c not in ("px", "band", "band_order")]
    if bands:
        df = banded(df).orderBy("band_order", "lat", "lon", "start")
    df.select(*[F.col(c).alias(n) for c, n in HEADINGS.items()], *[F.col(f"`{c}`") for c in extra]).write.csv(path, header=True)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """One float a line; a line that is no number is NULL."""
    return spark.read.text(path).select(F.col("value").try_cast("double").alias("value"))


def write_numbers(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """i, j, value of the two-dimensional .npy maps at a path; NaN is NULL. Files are read where the tasks run; a tile's name says where it begins."""

    def cells(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                a = np.load(io.BytesIO(raw))
                begin = re.search(r"tile_(\d+)_(\d+)\.npy$", name)
                i, j = np.indices(a.shape)
                if begin:
                    i, j = i + int(begin[1]), j + int(begin[2])
                v = a.astype(float).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(v, mask=np.isnan(v))], ["i", "j", "value"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(cells, "i int, j int, value double")


def write_map(df: DataFrame, rows: int, cols: int, path: str, i: str = "i", j: str = "j", value: str = "value", tile: int = 1024) -> int:
    """A map as .npy tiles of ``tile`` x ``tile`` cells at most, NaN where there is no row; each is put together by the task that has its rows. Says how many there are.

    A tile has one name and the same bytes whenever it is written, so a task that runs twice does no harm. A cell with several rows has the greatest value.
    """
    high, wide = -(-rows // tile), -(-cols // tile)
    spark = df.sparkSession
    inside = F.col(i).between(0, rows - 1) & F.col(j).between(0, cols - 1)
    known = df.filter(F.col(value).isNotNull() & inside).select(F.col(i).cast("int").alias("i"), F.col(j).cast("int").alias("j"), F.col(value).cast("double").alias("value"))
    known = known.groupBy("i", "j").agg(F.max("value").alias("value")).withColumn("tile", F.expr(f"i div {tile} * {wide} + j div {tile}"))
    each = spark.range(high * wide).select(F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("value"), F.col("id").alias("tile"))

    def save(part):
        at = int(part["tile"].iloc[0])
        i0, j0 = at // wide * tile, at % wide * tile
        out = np.full((min(tile, rows - i0), min(tile, cols - j0)), np.nan)
        there = part[part["i"].notna()]
        out[there["i"].to_numpy(int) - i0, there["j"].to_numpy(int) - j0] = there["value"]
        system, root = open_fs(path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(temporary := f"{root}/_{uuid.uuid4().hex}", compression=None) as sink:
            np.save(sink, out)
        system.move(temporary, f"{root}/tile_{i0}_{j0}.npy")
        return pd.DataFrame({"tiles": [1]})

    return known.unionByName(each).groupBy("tile").applyInPandas(save, "tiles long").agg(F.sum("tiles")).first()[0]


class Overlap(ValueError):
    """Files that have days of a place in common, or other places than the rest."""


def read_merged(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """px, day and ``columns`` of many Parquet files as one panel, columns by name; Overlap, with the files' names, where two have a place's day or unlike places.

    What each file covers is counted by file, and only counts and the days that several files have are compared.
    """
    rows = spark.read.parquet(*paths).select("px", "day", *columns, F.col("_metadata.file_path").alias("file"))
    both = rows.groupBy("px", "day").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("a"), F.max("file").alias("b")).filter("n > 1").head(1)
    if both:
        raise Overlap(f"{both[0]['a']} and {both[0]['b']} both have {both[0]['day']} of place {both[0]['px']}")
    grids = rows.select("file", "px").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("px").cast("decimal(38,0)")).alias("h"))
    unlike = grids.groupBy("n", "h").agg(F.min("file").alias("file")).orderBy("n", "h").limit(2).collect()
    if len(unlike) > 1:
        raise Overlap(f"{unlike[0]['file']} and {unlike[1]['file']} have other places")
    return rows.drop("file")


def files_with(spark: SparkSession, folder: str, part: str) -> list[str]:
    """Names of the files of a folder that have ``part`` in them, ascending (a year, a quartile)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName() for x in found if part in x.getPath().getName())


def read_files_with(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """The tables of a folder whose names have ``part`` in them, as one; FileNotFoundError without any."""
    names = files_with(spark, folder, part)
    if not names:
        raise FileNotFoundError(f"no file with {part} in {folder}")
    return spark.read.parquet(*[f"{folder}/{n}" for n in names])


def described(df: DataFrame, comments: dict[str, str], coords: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """The rows with comments (names, units) on their columns and coordinates to three places."""
    out = df.withColumns({c: rounded(F.col(c)) for c in coords if c in df.columns})
    for c, text in comments.items():
        out = out.withMetadata(c, {"comment": text})
    return out
