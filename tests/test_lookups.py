"""As-of joins, regridding, window lookups, map tiles and merged files against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxpanel.functions import asof
from fluxpanel.operators import enrich, regrid
from fluxpanel.sources import ingest


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


def test_nearest_stamps_equal_brute_force(spark):
    rnd = random.Random(2)
    stamps = [(rnd.randrange(4), day(rnd.randrange(400)), rnd.randrange(9), "x") for _ in range(60)] + [(None, day(3), 1, "x"), (1, None, 2, "x")]
    stamps += [(k, d, c + 1, e) for k, d, c, e in stamps[:10]]  # two of one time
    rows = [(rnd.choice([None, 0, 1, 2, 3, 9]), rnd.choice([None, *map(day, range(-30, 460))]), i, "clash") for i in range(400)] + [(2, day(7), 400, "clash")] * 2
    out = asof.with_nearest(spark.createDataFrame(rows, "k int, d date, i int, cls string").repartition(5), spark.createDataFrame(stamps, "k int, s date, cls int, extra string"), ["k"], "d", "s", ["cls"])
    assert out.columns == ["k", "d", "i", "cls"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(abs((s - r["d"]).days), (s - r["d"]).days, -c) for k, s, c, _ in stamps if k is not None and k == r["k"] and s is not None] if r["d"] else []
        assert r["cls"] == (-min(mine)[2] if mine else None), r
    none = asof.with_nearest(spark.createDataFrame(rows, "k int, d date, i int, cls string"), spark.createDataFrame([], "k int, s date, cls int"), ["k"], "d", "s", ["cls"])
    assert none.count() == len(rows) and none.filter("cls is not null").count() == 0


def test_nearest_reads_each_side_once(spark):
    rows, stamps = spark.createDataFrame([(1, day(1))], "k int, d date"), spark.createDataFrame([(1, day(2), 5)], "k int, s date, c int")
    plan = asof.with_nearest(rows, stamps, ["k"], "d", "s", ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(k") <= 2


@pytest.mark.parametrize("seed", range(3))
def test_regridding_equals_interpolation(spark, seed):
    rnd = np.random.default_rng(seed)
    lat, lon = np.sort(rnd.uniform(0, 10, 6)), np.sort(rnd.uniform(0, 10, 5))
    if seed:
        lat = lat[::-1].copy()
    to_lat, to_lon = np.concatenate([rnd.uniform(-1, 11, 7), lat[:2]]), np.concatenate([rnd.uniform(-1, 11, 6), lon[-1:]])[::-1]
    grid = rnd.normal(size=(6, 5))
    if seed == 2:
        grid[2, 3] = np.nan
    rows = [(1, i, j, None if np.isnan(grid[i, j]) else float(grid[i, j])) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(rows, "day int, row int, col int, value double")
    out = regrid.regridded(df, regrid.axis(spark, lat.tolist(), to_lat.tolist()), regrid.axis(spark, lon.tolist(), to_lon.tolist()))
    got = {(r["row"], r["col"]): r["value"] for r in out.collect()}
    up = np.argsort(lat)
    for i, y in enumerate(to_lat):
        for j, x in enumerate(to_lon):
            if not (lat.min() <= y <= lat.max() and lon.min() <= x <= lon.max()):
                assert (i, j) not in got
                continue
            a, b = (np.zeros(6), np.zeros(5))
            for k in range(6):
                a[k] = np.interp(y, lat[up], (np.arange(6) == k)[up].astype(float))
            for k in range(5):
                b[k] = np.interp(x, lon, (np.arange(5) == k).astype(float))
            used = grid[np.ix_(a > 0, b > 0)]
            want = None if np.isnan(used).any() else float(a[a > 0] @ used @ b[b > 0])
            assert got[i, j] == (want if want is None else pytest.approx(want, abs=1e-12))
    with pytest.raises(ValueError):
        regrid.weights([0.0, 2.0, 1.0], [0.5])


def test_half_cells_are_a_case_of_it(spark):
    df = spark.createDataFrame([(1, i, j, float(i * i + 3 * j)) for i in range(4) for j in range(4) if (i, j) != (2, 2)], "day int, row int, col int, value double")
    axis = regrid.axis(spark, [0.0, 1.0, 2.0, 3.0], [0.5, 1.5, 2.5])
    a = {(r["row"], r["col"]): r["value"] for r in regrid.regridded(df, axis, axis).collect()}
    b = {(r["row"], r["col"]): r["value"] for r in ingest.half_cell_regrid(df).collect()}
    assert {k: v for k, v in a.items() if v is not None} == b and len(a) == 9


@pytest.mark.parametrize("kind", ["mean", "min", "max", "sum"])
@pytest.mark.parametrize("first,last", [(0, 20), (-30, -1), (-3, 4), (0, 0), (-7, 8)])
def test_window_sums_equal_the_windows(spark, kind, first, last):
    rnd = random.Random(f"{kind}{first}{last}")
    rows = [(px, day(i), None if rnd.random() < 0.3 or (px == 2 and i < 60) else rnd.gauss(0, 2)) for px in range(3) for i in range(120)]
    panel = spark.createDataFrame(rows, "px int, day date, v double").repartition(3)
    events = spark.createDataFrame([(px, day(i), day(i + 9)) for px in range(4) for i in [0, 1, 29, 30, 31, 50, 90, 98, 99, 110, 119]], "px int, start date, end date")
    for smooth in (None, 5):
        one = enrich.add_window(events, panel, "v", "v", kind, first, last, smooth)
        two = enrich.add_window_by_sums(events, panel, "v", "v", kind, first, last, smooth)
        assert one.columns == two.columns
        a, b = ({(r["px"], r["start"]): r[-1] for r in x.collect()} for x in (one, two))
        assert a.keys() == b.keys() and len(a) == 44
        assert all(a[k] == (b[k] if b[k] is None else pytest.approx(b[k], abs=1e-9)) for k in a)


def test_window_sums_send_two_rows_an_event(spark):
    panel = spark.createDataFrame([(1, day(i), float(i)) for i in range(500)], "px int, day date, v double")
    events = spark.createDataFrame([(1, day(250), day(260))], "px int, start date, end date")
    for last in (3, 200):
        plan = enrich.add_window_by_sums(events, panel, "v", "v", "mean", 0, last, span=(day(0), day(499)))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1 and "sequence" not in plan


def test_map_tiles_are_written_by_tasks(spark, tmp_path):
    cells = [(i, j, float(i * 10 + j)) for i in range(7) for j in range(5) if (i + j) % 3] + [(0, 1, 0.5), (6, 4, None), (9, 9, 1.0)]
    df = spark.createDataFrame(cells, "i int, j int, value double").repartition(4)
    for _ in range(2):  # again: the same files
        assert ingest.write_map(df, 7, 5, str(tmp_path / "map"), tile=3) == 6
    assert sorted(p.name for p in (tmp_path / "map").iterdir()) == [f"tile_{i}_{j}.npy" for i in (0, 3, 6) for j in (0, 3)]
    assert np.load(tmp_path / "map/tile_6_3.npy").shape == (1, 2)
    got = {(r["i"], r["j"]): r["value"] for r in ingest.read_map(spark, str(tmp_path / "map")).collect()}
    want = {(i, j): float(i * 10 + j) if (i + j) % 3 else None for i in range(7) for j in range(5)}
    assert got == want
    assert ingest.write_map(df.limit(0), 2, 2, str(tmp_path / "none")) == 1


def test_files_that_overlap_or_differ_are_named(spark, tmp_path):
    put = lambda name, px, lo, hi, *cols: spark.createDataFrame([(p, day(i), float(i)) for p in px for i in range(lo, hi)], "px int, day date, v double").select(*(cols or ("px", "day", "v"))).coalesce(1).write.parquet(str(tmp_path / name))
    put("a", [1, 2], 0, 10)
    put("b", [1, 2], 10, 20, "v", "px", "day")
    put("c", [2, 1], 19, 25)
    put("d", [1, 3], 20, 25)
    at = lambda *names: [str(tmp_path / n) for n in names]
    rows = ingest.read_merged(spark, at("a", "b"), ["v"])
    assert rows.columns == ["px", "day", "v"] and rows.filter(F.col("day") == F.date_add(F.lit(day(0)), F.col("v").cast("int"))).count() == 40
    with pytest.raises(ingest.Overlap, match=r"/b/.* and .*/c/.*2000-01-20"):
        ingest.read_merged(spark, at("a", "b", "c"), ["v"])
    with pytest.raises(ingest.Overlap, match=r"(/d/.* and .*/[ab]/|/[ab]/.* and .*/d/).*other places"):
        ingest.read_merged(spark, at("a", "b", "d"), ["v"])


def test_bucketed_panels_join_without_an_exchange_of_them(spark):
    from fluxpanel.operators import composite, events
    from fluxpanel.operators.events import Rule
    from fluxpanel.plans import buckets

    rnd = random.Random(1)
    rows = [(px, day(i), rnd.gauss(0, 1), 290.0, rnd.gauss(0, 1)) for px in range(6) for i in range(300)]
    both = spark.createDataFrame(rows, "px int, day date, z double, t double, x double")
    z, x = buckets.bucketed(both.select("px", "day", "z", "t"), 4, "z"), buckets.bucketed(both.select("px", "day", "x"), 4, "x")
    rule = Rule(prior=-9.0, after=-0.3, below=-0.3, min_days=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with buckets.bucket_joins(spark):
            feats = events.features(z)
            plan = feats._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            joined = x.join(feats, ["px", "day"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
            found = events.intervals(feats, rule)
            rows_of = composite.aligned(found, x, 5, ["x"], [])
            plan = rows_of._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Bucketed: true") >= 2
            got = sorted(map(tuple, composite.composite(found, x, "x", 5).collect()))
        assert sorted(map(tuple, joined.select("px", "day", "x").collect())) == sorted((r[0], r[1], r[4]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = composite.composite(events.intervals(events.features(both), rule), both.select("px", "day", "x"), "x", 5)
    want = sorted(map(tuple, plain.collect()))
    assert [(a[0], a[2]) for a in got] == [(a[0], a[2]) for a in want] and all(a[1] == pytest.approx(b[1]) for a, b in zip(got, want, strict=True)) and want[0][2] > 5


def test_a_legend_is_bounded(spark):
    from fluxpanel.operators import landcover

    with pytest.raises(ValueError, match="classes"):
        landcover.legend(spark.range(landcover.MOST_CLASSES + 1).selectExpr("string(id) land_cover", "int(id) flag"))
