"""Events as they become final, from raw values that keep arriving: a stream with a checkpoint.

    spark-submit jobs/live_events.py --tables DIR --out DIR --checkpoint DIR [--config FILE]

Reads new files of the table lineitem since the last run, with orders and customer beside them, and appends events to out/events, by the year of their start.
The first run makes out/baseline, the climatology of the configured days, from the tables as they are then; later runs read it.

Configuration: ``first_day`` of the record; ``delay_days``, how many days behind the latest row others may come; the ``baseline`` days; the ``rule``;
``files_at_once`` of a micro-batch (all that are new if null: files that are not in order of time need one batch, or a delay as long as they reach).
A row behind the watermark is late and left out. A run that was cut short is taken up from the checkpoint; one without new files adds nothing.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging
import sys
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fluxpanel.operators import anomaly
from fluxpanel.operators.events import Rule
from fluxpanel.plans.panel import order_panel, read
from fluxpanel.plans.resume import read_if_there
from fluxpanel.streaming import raw

log = logging.getLogger("live_events")
CONFIG = Path(__file__).with_suffix(".json")
EVENTS = "px int, start date, end date, length int, max_intensity double, year int"
BASELINE = "px int, md string, clim_mean double, clim_std double"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session with these settings; as it was before afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def baseline(spark: SparkSession, tables: str, out: str, days: list[str]) -> DataFrame:
    """The climatology that anomalies are against, made once."""
    path = f"{out}/baseline"
    if read_if_there(spark, path, BASELINE).isEmpty():
        rows = order_panel(spark, tables).filter(F.col("day").between(*[F.lit(d).cast("date") for d in days]))
        anomaly.climatology(rows, "v").select(F.col("px").cast("int").alias("px"), "md", "clim_mean", "clim_std").write.mode("overwrite").parquet(path)
    held = spark.read.schema(BASELINE).parquet(path)
    log.info("baseline of %s: %s rows", days, held.count())
    return held


def new_rows(spark: SparkSession, tables: str, files_at_once: int | None) -> DataFrame:
    """px, ts, value and t of the lines that have arrived since."""
    path = f"{tables}/lineitem.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern of this one name: file streams take folders and patterns, and the table may be a folder or a file
    lines = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(f"{path[:-1]}[t]")
    lines = lines.select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("ts"), "l_quantity", "l_extendedprice")
    orders = read(spark, tables, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, tables, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("px"))
    # orders get their places first, so that lines are shuffled once
    places = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "px")
    rows = lines.join(places, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("px", "ts", F.col("l_quantity").alias("value"), (F.lit(275.15) + F.col("l_extendedprice") / F.lit(7001.3)).alias("t"))


def run(spark: SparkSession, tables: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new, waits for the stream to end, and returns all events found so far."""
    events = f"{out}/events"
    clim = baseline(spark, tables, out, config["baseline"])
    # the log of finished files says what a run before has written
    before = read_if_there(spark, events, EVENTS).count()
    with settings(spark, raw.NEEDED):
        found = raw.detect_raw(new_rows(spark, tables, config.get("files_at_once")), dt.date.fromisoformat(config["first_day"]), rule=Rule(**config["rule"]), delay=f"{config['delay_days']} days", climatology=clim)
        sink = found.withColumn("year", F.year("start")).writeStream.format("parquet").partitionBy("year").option("path", events).option("checkpointLocation", checkpoint)
        query = sink.outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    for p in query.recentProgress:
        log.info("batch %s: read %s rows, watermark %s, late %s", p["batchId"], p["numInputRows"], p["eventTime"].get("watermark"), sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]))
    now = read_if_there(spark, events, EVENTS)
    log.info("events before: %s, now: %s", before, now.count())
    return now


def load(path: str | None) -> dict:
    return json.loads(Path(path or CONFIG).read_text())


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tables", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("live_events").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.tables, given.out, given.checkpoint, load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
