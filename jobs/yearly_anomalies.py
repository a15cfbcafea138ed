"""Daily values by place, their climatology and their anomalies, year by year: what is finished stays, what is absent is written.

    spark-submit jobs/yearly_anomalies.py --tables DIR --out DIR [--config FILE]

From the tables lineitem, orders, customer and nation it writes, below the output folder and by year,

* panel: px, day, v, n, u on the gap-free calendar;
* parts and turns: count, mean and squared distance of each place and calendar day (``fluxpanel.operators.parts``);
* anomalies: px, day, v and z, by the climatology of the baseline years;
* marks: which years of which stage are finished.

Configuration: ``first_day`` and ``last_day`` of the record, the first and last ``baseline`` year, how many years a pass writes at most
(``years_at_once``) and the years to write again in place (``rewrite``). A year of the record without a single row is an error, as is a baseline that
is not within the record; no mark is written for it. A second run over the same tables writes nothing. A run that was cut short is taken up at the first
year without a mark. A later ``last_day`` adds years, and writes the last one again if its days have become more, with all that is made from it.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fluxpanel.operators import parts
from fluxpanel.plans import resume
from fluxpanel.plans.panel import densify, order_values, read

log = logging.getLogger("yearly_anomalies")
CONFIG = Path(__file__).with_suffix(".json")
PANEL = "px int, day date, v double, n bigint, u double, year int"
PARTS = parts.PART + ", year int"
ANOMALIES = "px int, day date, v double, z double, year int"


def chunks(years: list[int], size: int) -> list[list[int]]:
    return [years[i : i + size] for i in range(0, len(years), size)]


def write_panel(spark: SparkSession, tables: str, out: str, years: list[int], bases: dict[int, str], config: dict) -> None:
    """Writes the years' days of every place; ValueError for a year without a value."""
    first, last = max(config["first_day"], f"{years[0]}-01-01"), min(config["last_day"], f"{years[-1]}-12-31")
    wanted = F.year("day").isin(years)
    values = order_values(spark, tables).filter(wanted)
    places = read(spark, tables, "nation").select(F.col("n_nationkey").cast("int").alias("px"))
    rows = densify(values, places, first, last).filter(wanted).withColumn("year", F.year("day"))
    resume.write_parts(rows.repartition("year", "px").sortWithinPartitions("year", "px", "day").select("px", "day", "v", "n", "u", "year"), f"{out}/panel", ["year"])
    panel = spark.read.schema(PANEL).parquet(f"{out}/panel").filter(F.col("year").isin(years))
    seen = {r["year"]: r for r in panel.groupBy("year").agg(F.count("v").alias("values"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("lines")).collect()}
    if empty := [y for y in years if y not in seen or not seen[y]["values"]]:
        raise ValueError(f"no input for the years {empty}")
    for y in years:
        log.info("panel %s: read %s lines, wrote %s rows with %s values", y, seen[y]["lines"], seen[y]["rows"], seen[y]["values"])
    resume.mark(spark, f"{out}/marks", "panel", {y: seen[y]["rows"] for y in years}, bases)


def write_stage(spark: SparkSession, out: str, stage: str, rows: DataFrame, years: list[int], bases: dict[int, str], by_px: bool = False) -> None:
    if by_px:
        rows = rows.repartition("year", "px").sortWithinPartitions("year", "px", "day")
    resume.write_parts(rows, f"{out}/{stage}", ["year"])
    made = resume.counts(spark.read.parquet(f"{out}/{stage}").filter(F.col("year").isin(years)))
    for y in years:
        log.info("%s %s: wrote %s rows", stage, y, made.get(y, 0))
    resume.mark(spark, f"{out}/marks", stage, {y: made.get(y, 0) for y in years}, bases)


def run(spark: SparkSession, tables: str, out: str, config: dict) -> DataFrame:
    """Brings the tables below ``out`` up to date and returns the anomalies as they then are."""
    at, size = f"{out}/marks", int(config.get("years_at_once") or 1000)
    span = range(int(config["first_day"][:4]), int(config["last_day"][:4]) + 1)
    base = range(config["baseline"][0], config["baseline"][1] + 1)
    if outside := [y for y in base if y not in span]:
        raise ValueError(f"baseline years that are not in the record: {outside}")
    held = resume.marks(spark, at)
    # a year that the last day of its time cut off has another base once there are more days
    bases = {y: f"{max(config['first_day'], f'{y}-01-01')} to {min(config['last_day'], f'{y}-12-31')}" for y in span}
    new = resume.stale(held, "panel", bases, config.get("rewrite", []))
    for years in chunks(new, size):
        write_panel(spark, tables, out, years, bases, config)
    panel = spark.read.schema(PANEL).parquet(f"{out}/panel").filter(F.col("year").between(span[0], span[-1]))
    held = resume.marks(spark, at)
    bases = {y: resume.base_of(held, ("panel", y)) for y in base}
    own = resume.stale(held, "parts", bases)
    for years in chunks(own, size):
        write_stage(spark, out, "parts", parts.year_parts(panel.filter(F.col("year").isin(years)), "v"), years, bases)
    bases = {y: resume.base_of(held, ("panel", y - 1), ("panel", y)) for y in base if y - 1 in base}
    turns = resume.stale(held, "turns", bases)
    for years in chunks(turns, size):
        days = panel.filter(F.col("year").isin(sorted({*years, *(y - 1 for y in years)})))
        write_stage(spark, out, "turns", parts.turn_parts(days, "v").filter(F.col("year").isin(years)), years, bases)
    held = resume.marks(spark, at)
    used = [*(("parts", y) for y in base), *(("turns", y) for y in bases)]
    bases = {y: resume.base_of(held, ("panel", y), *used) for y in span}
    todo = resume.stale(held, "anomalies", bases)
    if todo:
        tables_of = [resume.read_if_there(spark, f"{out}/{stage}", PARTS).filter(F.col("year").isin([y for s, y in used if s == stage])) for stage in ("parts", "turns")]
        clim = parts.merged(tables_of[0].unionByName(tables_of[1]))
        for years in chunks(todo, size):
            rows = panel.filter(F.col("year").isin(years)).withColumn("md", F.date_format("day", "MM-dd")).join(clim, ["px", "md"], "left")
            z = (F.col("v") - F.col("clim_mean")) / F.col("clim_std")
            write_stage(spark, out, "anomalies", rows.select("px", "day", "v", z.alias("z"), "year"), years, bases, by_px=True)
    log.info("years written: panel %s, parts %s, turns %s, anomalies %s", new, own, turns, todo)
    return spark.read.schema(ANOMALIES).parquet(f"{out}/anomalies").filter(F.col("year").between(span[0], span[-1]))


def load(path: str | None) -> dict:
    return json.loads(Path(path or CONFIG).read_text())


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("yearly_anomalies").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.tables, given.out, load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
