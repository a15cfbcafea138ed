"""Tables partitioned by year that jobs add to and resume: a small table says which years of which stage are finished, and from what.

A stage's rows are written with dynamic partition overwrite and marked afterwards. A run that is cut short leaves years without a mark; the next one
writes those again, in place. A mark has a stamp of its own and the stamps of what its rows were made from, so a year whose sources have been
written since is stale and made again too. Everything is Spark's reading and writing of Parquet.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "rows bigint, stamp string, base string, stage string, year int"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows of its schema where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that the rows are of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def marks(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[str, str]]:
    """(stamp, base) of each stage and year that is finished."""
    return {(r["stage"], r["year"]): (r["stamp"], r["base"]) for r in read_if_there(spark, path, MARKS).collect()}  # a row for each


def mark(spark: SparkSession, path: str, stage: str, rows: dict[int, int], bases: dict[int, str]) -> None:
    """Marks years of a stage as finished, with their numbers of rows and what they were made from."""
    if rows:
        made = [(n, uuid.uuid4().hex, bases[y], stage, y) for y, n in rows.items()]
        write_parts(spark.createDataFrame(made, MARKS).coalesce(1), path, ["stage", "year"])


def base_of(held: dict[tuple[str, int], tuple[str, str]], *sources: tuple[str, int]) -> str:
    """What a year made from the given stages and years is made from, as their stamps have it."""
    return hashlib.sha256("|".join(held[s][0] if s in held else "" for s in sources).encode()).hexdigest()[:32]


def stale(held: dict[tuple[str, int], tuple[str, str]], stage: str, bases: dict[int, str], again: Iterable[int] = ()) -> list[int]:
    """Years of a stage that are to be written: those without a mark or of another base, and ``again``."""
    again = set(again)
    return [y for y, base in bases.items() if y in again or (stage, y) not in held or held[stage, y][1] != base]


def counts(df: DataFrame) -> dict[int, int]:
    """Rows by year."""
    return {r["year"]: r["n"] for r in df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
