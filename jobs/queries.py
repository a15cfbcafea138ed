"""The jobs as queries: each runs twice into a new folder below the shared one and returns all it has written by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.oracle import ORACLE_SQL as PANEL_SQL
from fluxpanel.oracle import sql
from fluxpanel.plans.panel import new_path

from . import live_events, yearly_anomalies


def job1_yearly_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = new_path(spark, "job1"), yearly_anomalies.load(None)
    yearly_anomalies.run(spark, sf_dir, out, config)
    rows = yearly_anomalies.run(spark, sf_dir, out, config)
    return rows.select("px", "day", F.round("v", 9).alias("v"), F.round(F.col("z").cast("float").cast("double"), 9).alias("z"), "year")


def job2_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = new_path(spark, "job2"), live_events.load(None)
    live_events.run(spark, sf_dir, out, f"{out}/checkpoint", config)
    rows = live_events.run(spark, sf_dir, out, f"{out}/checkpoint", config)
    return rows.select("px", "start", "end", "length", F.round("max_intensity", 6).alias("max_intensity"), "year")


QUERIES = {"job1_yearly_anomalies": job1_yearly_anomalies, "job2_live_events": job2_live_events}

ORACLE_SQL = {
    "job1_yearly_anomalies": sql(
        "dense", "SELECT d.px, d.day, round(v, 9) AS v, round(CAST(CAST((v - m) / s AS FLOAT) AS DOUBLE), 9) AS z, CAST(year(d.day) AS INTEGER) AS year FROM dense d JOIN jc ON jc.px = d.px AND jc.md = strftime(d.day, '%m-%d')",
        bd="SELECT px, day, v FROM dense WHERE year(day) BETWEEN 1995 AND 2000",
        jc="SELECT a.px, strftime(a.day, '%m-%d') AS md, avg(b.v) AS m, CASE WHEN stddev_pop(b.v) > 1e-7 THEN stddev_pop(b.v) END AS s FROM bd a JOIN bd b ON a.px = b.px AND b.day BETWEEN a.day - 3 AND a.day + 3 GROUP BY ALL",
    ),
    # an event is final once the day that ends it is 32 days behind the last closed day, which is four days behind the latest line
    "job2_live_events": f"SELECT *, CAST(year(start) AS INTEGER) AS year FROM ({PANEL_SQL['event_catalogue']}) WHERE \"end\" <= (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) - 36",
}
