"""The two jobs: over growing input, cut short and taken up again, against the batch operators."""

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fluxpanel.operators import anomaly, events, parts
from fluxpanel.operators.events import Rule
from fluxpanel.plans import resume
from fluxpanel.plans.panel import order_panel
from jobs import live_events, yearly_anomalies

SF = "/root/testdata/sf0.01"
SMALL = {"first_day": "1995-01-01", "last_day": "1998-12-31", "baseline": [1995, 1997], "years_at_once": 1}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A copy of the tables with the lines by year, in one file a year, not in order of time within it."""
    path = tmp_path_factory.mktemp("tables")
    for t in ("nation", "customer", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{path}/{t}.parquet")
    return path


def add_lines(spark, tables, name, years, where="true", copies=1):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter(F.year("l_shipdate").isin(years)).filter(where)
    for _ in range(copies):
        lines.orderBy(F.xxhash64("l_orderkey", "l_linenumber")).coalesce(1).write.mode("append").parquet(f"{tables}/{name}")


def copy_of(spark, tables, tmp_path, years):
    """A folder with the small tables, by links, and lines of its own."""
    for t in ("nation", "customer", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(tables / f"{t}.parquet")
    for y in years:
        add_lines(spark, tmp_path, "lineitem.parquet", [y])
    return str(tmp_path)


def expected(spark, tables, config):
    """px, day and z of the record, by the batch climatology of the baseline years."""
    panel = order_panel(spark, tables).filter(F.col("day").between(config["first_day"], config["last_day"]))
    clim = anomaly.climatology(panel.filter(F.year("day").between(*config["baseline"])), "v")
    rows = panel.withColumn("md", F.date_format("day", "MM-dd")).join(clim, ["px", "md"])
    return {(r["px"], r["day"]): r["z"] for r in rows.select("px", "day", ((F.col("v") - F.col("clim_mean")) / F.col("clim_std")).alias("z")).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in ((got[k], want[k]) for k in got))


def anomalies(df):
    rows = df.select("px", "day", "z").collect()
    assert len({(r["px"], r["day"]) for r in rows}) == len(rows)
    return {(r["px"], r["day"]): r["z"] for r in rows}


def stamps(spark, out):
    return {k: v[0] for k, v in resume.marks(spark, f"{out}/marks").items()}


def test_anomalies_resume_grow_and_raise(spark, tables, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    path, out = copy_of(spark, tables, tmp_path / "in", [1995, 1996, 1997]), str(tmp_path / "out")
    # a year without input raises and is not marked; those before it are
    with pytest.raises(ValueError, match="1998"):
        yearly_anomalies.run(spark, path, out, SMALL)
    assert {k for k in stamps(spark, out)} == {("panel", 1995), ("panel", 1996), ("panel", 1997)}
    add_lines(spark, path, "lineitem.parquet", [1998])
    # cut short after two years of anomalies: the next run writes the other two
    before, stage = stamps(spark, out), yearly_anomalies.write_stage

    def broken(spark_, out_, name, rows, years, *a, **k):
        if name == "anomalies" and 1997 in years:
            resume.write_parts(rows.limit(10), f"{out_}/{name}", ["year"])  # rows are there, but no mark
            raise KeyboardInterrupt
        stage(spark_, out_, name, rows, years, *a, **k)

    monkeypatch.setattr(yearly_anomalies, "write_stage", broken)
    with pytest.raises(KeyboardInterrupt):
        yearly_anomalies.run(spark, path, out, SMALL)
    monkeypatch.setattr(yearly_anomalies, "write_stage", stage)
    cut = stamps(spark, out)
    assert {y for s, y in cut if s == "anomalies"} == {1995, 1996} and all(cut[k] == v for k, v in before.items())
    got = anomalies(yearly_anomalies.run(spark, path, out, SMALL))
    done = stamps(spark, out)
    assert {k for k in done if k not in cut} == {("anomalies", 1997), ("anomalies", 1998)} and all(done[k] == v for k, v in cut.items())
    same(got, expected(spark, path, SMALL))
    # nothing new: nothing is written
    same(anomalies(yearly_anomalies.run(spark, path, out, SMALL)), got)
    assert stamps(spark, out) == done
    # a year more, cut off in March, then whole: only that year is written
    add_lines(spark, path, "lineitem.parquet", [1999], "l_shipdate < '1999-03-11'")
    longer = SMALL | {"last_day": "1999-03-10"}
    yearly_anomalies.run(spark, path, out, longer)
    part = stamps(spark, out)
    assert {k for k in part if part[k] != done.get(k)} == {("panel", 1999), ("anomalies", 1999)}
    add_lines(spark, path, "lineitem.parquet", [1999], "l_shipdate >= '1999-03-11'")
    longer = SMALL | {"last_day": "1999-12-31"}
    got = anomalies(yearly_anomalies.run(spark, path, out, longer))
    assert {k for k, v in stamps(spark, out).items() if v != part[k]} == {("panel", 1999), ("anomalies", 1999)}
    same(got, expected(spark, path, longer))
    # one year written again in place, from changed input: with it go its part, its turns and what is against them
    add_lines(spark, path, "lineitem.parquet", [1996], "l_quantity > 40")
    last = stamps(spark, out)
    got = anomalies(yearly_anomalies.run(spark, path, out, longer | {"rewrite": [1996]}))
    changed = {k for k, v in stamps(spark, out).items() if v != last[k]}
    assert changed == {("panel", 1996), ("parts", 1996), ("turns", 1996), ("turns", 1997), *(("anomalies", y) for y in range(1995, 2000))}
    same(got, expected(spark, path, longer))
    # a wider baseline: older parts are not made again
    wider = longer | {"baseline": [1995, 1998]}
    last = stamps(spark, out)
    same(anomalies(yearly_anomalies.run(spark, path, out, wider)), expected(spark, path, wider))
    assert {k for k, v in stamps(spark, out).items() if v != last.get(k) and k[0] != "anomalies"} == {("parts", 1998), ("turns", 1998)}
    with pytest.raises(ValueError, match="baseline"):
        yearly_anomalies.run(spark, path, out, SMALL | {"baseline": [1994, 1996]})


def test_parts_of_years_read_one_by_one_equal_the_climatology(spark, tmp_path):
    panel = order_panel(spark, SF).select("px", "day", "v").withColumn("year", F.year("day"))
    panel.write.partitionBy("year").parquet(str(tmp_path / "panel"))
    years = spark.read.parquet(str(tmp_path / "panel"))
    for y in range(1995, 2002):
        one = parts.year_parts(years.filter(F.col("year") == y).drop("year"), "v")
        assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString() and len(one.inputFiles()) == len(years.filter(F.col("year") == y).inputFiles())
        one.write.mode("append").parquet(str(tmp_path / "parts"))
        if y > 1995:
            edge = years.filter(F.col("year").isin(y - 1, y) & parts.near_turns(F.col("day"))).drop("year")
            assert edge.select("day").distinct().count() <= 12
            turn = parts.turn_parts(edge, "v")
            assert [r["year"] for r in turn.select("year").distinct().collect()] == [y]
            turn.write.mode("append").parquet(str(tmp_path / "parts"))
    got = {(r["px"], r["md"]): r for r in parts.merged(spark.read.parquet(str(tmp_path / "parts"))).collect()}
    want = {(r["px"], r["md"]): r for r in anomaly.climatology(panel, "v").filter("clim_mean is not null").collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert abs(got[k]["clim_mean"] - w["clim_mean"]) < 1e-9 and (got[k]["clim_std"] or 0) == pytest.approx(w["clim_std"] or 0, abs=1e-7)
    empty = spark.createDataFrame([], "px int, day date, v double")
    assert parts.merged(parts.year_parts(empty, "v").unionByName(parts.turn_parts(empty, "v"))).count() == 0


RULE = {"prior": -0.25, "after": -0.5, "below": -0.5, "min_days": 7, "frozen": 278.15}
LIVE = {"first_day": "1995-01-01", "delay_days": 3, "baseline": ["1995-01-01", "1996-12-31"], "files_at_once": 1, "rule": RULE}


def final_events(spark, tables, last, config):
    """The batch's events up to a last day of lines that are final by then."""
    panel = order_panel(spark, tables).filter(F.col("day") <= F.lit(last))
    clim = anomaly.climatology(order_panel(spark, tables).filter(F.col("day").between(*config["baseline"])), "v")
    rows = panel.withColumn("md", F.date_format("day", "MM-dd")).join(clim, ["px", "md"], "left").withColumn("z", (F.col("v") - F.col("clim_mean")) / F.col("clim_std"))
    feats = events.features(rows)
    found = events.catalogue(events.intervals(feats, Rule(**config["rule"])), feats)
    shut = last - dt.timedelta(days=config["delay_days"] + 33)
    return {tuple(r) for r in found.filter(F.col("end") <= F.lit(shut)).select("px", "start", "end", "length", F.round("max_intensity", 6)).collect()}


def rows_of(df):
    rows = [tuple(r) for r in df.select("px", "start", "end", "length", F.round("max_intensity", 6)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_events_of_growing_input(spark, tables, tmp_path):
    (tmp_path / "in").mkdir()
    path, out, mark = copy_of(spark, tables, tmp_path / "in", [1995, 1996]), str(tmp_path / "out"), str(tmp_path / "mark")
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = rows_of(live_events.run(spark, path, out, mark, LIVE))
    last = spark.read.parquet(f"{path}/lineitem.parquet").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    assert first == final_events(spark, path, last, LIVE) and len(first) > 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == conf
    # no new files: nothing is added
    assert rows_of(live_events.run(spark, path, out, mark, LIVE)) == first
    # two years more, and a late line, which is left out
    add_lines(spark, path, "lineitem.parquet", [1997])
    add_lines(spark, path, "lineitem.parquet", [1998])
    second = rows_of(live_events.run(spark, path, out, mark, LIVE))
    last = spark.read.parquet(f"{path}/lineitem.parquet").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    assert second == final_events(spark, path, last, LIVE) and first < second
    add_lines(spark, path, "lineitem.parquet", [1996], "l_quantity > 30")
    assert rows_of(live_events.run(spark, path, out, mark, LIVE)) == second
    assert {p.name for p in Path(out, "events").iterdir() if p.name.startswith("year=")} <= {f"year={y}" for y in range(1995, 1999)}


def test_job_files_run_from_the_command_line(spark, tables, tmp_path):
    (tmp_path / "in").mkdir()
    path = copy_of(spark, tables, tmp_path / "in", [1995, 1996])
    config = tmp_path / "config.json"
    config.write_text(json.dumps(SMALL | {"last_day": "1996-12-31", "baseline": [1995, 1996], "years_at_once": 2}))
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, str(root / "jobs/yearly_anomalies.py"), "--tables", path, "--out", str(tmp_path / "out"), "--config", str(config)], capture_output=True, text=True, timeout=300, cwd=root, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "panel 1996: read" in done.stderr and "anomalies 1996: wrote 9150 rows" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out/anomalies")).count() == 25 * 731
