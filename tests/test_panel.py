"""Windows, events, statistics and clusters: known answers and brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fluxpanel import registry
from fluxpanel.functions import calendar, frames, grid, quartiles
from fluxpanel.operators import anomaly, clusters, composite, enrich, events, landcover, regions, sensitivity, stats
from fluxpanel.operators.events import Rule
from fluxpanel.plans.panel import common_span, densify, nulls
from fluxpanel.registry import Variable
from fluxpanel.sources import ingest

DAY0 = dt.date(2000, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def series(spark, values, px=1, name="v"):
    return spark.createDataFrame([(px, day(i), None if v is None else float(v)) for i, v in enumerate(values)], f"px int, day date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("px", "day").collect()]


@pytest.mark.parametrize(
    "values,expr,want",
    [
        ([1, None, None, None, 5], lambda: frames.centred_mean("v", 5, 2), [None, None, 3, None, None]),
        ([4, 3, 2, 1], lambda: frames.leading_min("v", 2), [2, 1, 1, None]),
        ([1, None, 3, 5], lambda: frames.trailing_mean("v", 3, 2), [None, None, 2, 4]),
        ([1, 5, None, 2], lambda: frames.leading_max("v", 3, 2), [5, 5, None, None]),
        (list(range(12)), lambda: frames.centred_mean("v", 10), [sum(range(max(0, i - 5), min(12, i + 5))) / len(range(max(0, i - 5), min(12, i + 5))) for i in range(12)]),
    ],
)
def test_frames(spark, values, expr, want):
    assert column(series(spark, values).withColumn("x", expr()), "x") == want


def test_first_after_and_onset(spark):
    df = series(spark, [0, 1, 1, 0, 1]).withColumn("f", F.col("v") == 1)
    df = df.withColumn("next", frames.first_after(F.col("v") == 1)).withColumn("on", frames.onset("f"))
    assert column(df, "next") == [day(1), day(2), day(4), day(4), None]
    assert column(df, "on") == [False, True, False, False, True]
    assert column(series(spark, [1, 1]).withColumn("f", F.col("v") == 1).withColumn("on", frames.onset("f")), "on") == [False, False]


def feature_rows(spark, starts, p, c=290.0, px=1, days=41):
    rows = []
    for i in range(days):
        begun = i in starts
        rows.append((px, day(i), p.get(i, 0.0) if i in p else 0.0, 0.0 if begun else -9.0, -5.0 if begun else 0.0, c.get(i, 290.0) if isinstance(c, dict) else c))
    return spark.createDataFrame(rows, "px int, day date, p double, b double, a double, c double")


def low(first, last, value=-2.0):
    return {i: value for i in range(first, last + 1)}


@pytest.mark.parametrize(
    "starts,p,c,want",
    [
        ([2], low(5, 19), 290.0, [(5, 20)]),
        ([2], low(5, 18), 290.0, []),
        ([2], {**low(5, 30), 12: None}, 290.0, []),
        ([10], low(5, 30), 290.0, [(11, 31)]),
        ([2, 10], low(5, 30), 290.0, [(5, 31)]),
        ([2], low(5, 19), {2: 270.0}, []),
        ([2], low(5, 19), {2: None}, [(5, 20)]),
        ([2], low(5, 40), 290.0, []),
        ([2], low(5, 19, -1.0), 290.0, []),
    ],
)
def test_event_fixtures(spark, starts, p, c, want):
    got = events.intervals(feature_rows(spark, starts, p, c), Rule()).collect()
    assert [((r["start"] - DAY0).days, (r["end"] - DAY0).days) for r in got] == want


@pytest.mark.parametrize("peak,kept", [(12, True), (2, True), (11, False)])
def test_growing_season(spark, peak, kept):
    months = spark.createDataFrame([(1, peak)], "px int, peak_month int")
    assert (events.intervals(feature_rows(spark, [2], low(5, 19)), Rule(), months).count() == 1) == kept


def brute_events(rows, rule):
    found = {}
    n = len(rows)
    for t, (p, b, a, c) in enumerate(rows):
        if b is None or a is None or not (b > rule.prior and a < rule.after) or (c is not None and c < rule.frozen):
            continue
        is_low = lambda i: rows[i][0] is not None and rows[i][0] < rule.below
        r = next((i for i in range(t + 1, n) if is_low(i)), None)
        o = None if r is None else next((i for i in range(r + 1, n) if not is_low(i)), None)
        if o is not None and o - r >= rule.min_days:
            found[o] = min(found.get(o, r), r)
    return sorted((r, o) for o, r in found.items())


@pytest.mark.parametrize("missing", [0.0, 0.25, 0.6])
@pytest.mark.parametrize("least", [5, 15])
def test_random_events_equal_a_loop(spark, missing, least):
    rnd, data, want = random.Random(int(missing * 100) + least), [], {}
    rule = Rule(prior=-0.25, after=-0.6, below=-0.6, min_days=least)
    for px in range(15):
        x, values = 0.0, []
        for _ in range(400):
            x = 0.95 * x + rnd.gauss(0, 0.35)
            values.append(None if rnd.random() < missing else x)
        rows = []
        for i in range(400):
            some = lambda v: [y for y in v if y is not None]
            b, a = some(values[max(0, i - 29) : i + 1]), some(values[i + 1 : i + 21])
            rows.append((values[i], sum(b) / len(b) if len(b) >= 5 else None, min(a) if a else None, rnd.choice([None, 270.0, 290.0, 290.0])))
        want[px] = brute_events(rows, rule)
        data += [(px, day(i), *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "px int, day date, p double, b double, a double, c double")
    ev = events.intervals(df, rule)
    got = {}
    for r in ev.collect():
        got.setdefault(r["px"], []).append(((r["start"] - DAY0).days, (r["end"] - DAY0).days))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    cat = events.catalogue(ev, df).collect()
    assert all(r["length"] == (r["end"] - r["start"]).days and r["max_intensity"] < rule.below for r in cat)
    marks = {(r["px"], r["day"]) for r in events.mask(ev).collect()}
    assert len(marks) == sum(o - s for v in want.values() for s, o in v)
    flags = df.join(events.mask(ev).withColumn("m", F.lit(True)), ["px", "day"], "left").withColumn("flag", F.coalesce("m", F.lit(False)))
    assert {tuple(r) for r in events.runs_of_mask(flags).collect()} == {tuple(r) for r in ev.select("px", "start", "end").collect()}


def test_climatology_pools_days_and_years(spark):
    rnd = random.Random(0)
    values = [None if rnd.random() < 0.2 else rnd.gauss(0, 1) for _ in range(366 + 365 + 365)]
    got = {r["md"]: r for r in anomaly.climatology(series(spark, values), "v").collect()}
    pools = {}
    for i in range(len(values)):
        pools.setdefault(day(i).strftime("%m-%d"), []).extend(v for v in values[max(0, i - 3) : i + 4] if v is not None)
    assert set(got) == set(pools)
    for md, pool in pools.items():
        mean = sum(pool) / len(pool)
        assert math.isclose(got[md]["clim_mean"], mean, abs_tol=1e-9)
        assert math.isclose(got[md]["clim_std"], math.sqrt(sum((x - mean) ** 2 for x in pool) / len(pool)), abs_tol=1e-8)
    assert len(pools["02-29"]) <= 7


def test_anomaly_of_constant_series_is_null_and_detrend(spark):
    assert set(column(anomaly.standardised(series(spark, [5] * 20), "v"), "z")) == {None}
    assert all(abs(x) < 1e-9 for x in column(anomaly.detrended(series(spark, [3 + 2 * i for i in range(10)]), "v"), "detrended"))
    assert column(anomaly.detrended(series(spark, [None] * 3), "v"), "detrended") == [None] * 3
    observed = column(anomaly.observed_climatology(series(spark, [0, 1, None]), "v"), "clim_mean")
    assert observed[0] is None and observed[1] is not None and observed[2] is None


def test_quartiles_and_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 3, 4, 5, 6, 7]] + [(None,)], "v double")
    rows = quartiles.with_quartile(df, "v").orderBy("v").collect()
    assert [r["quartile"] for r in rows] == [None, 1, 1, 2, 2, 3, 3, 4, 4]
    table = {r["percentile"]: r["value"] for r in quartiles.percentile_table(df, "v").collect()}
    assert (table[25], table[50], table[75], table[0], table[100]) == (1.75, 3.5, 5.25, 1.0, 7.0)


def test_mann_whitney_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1), (2.0, 4), (4.0, 4)], "v double, g int")
    r = stats.mann_whitney(df, "v", "g", 1, 4).first()
    assert (r["u"], r["p"], r["n1"], r["n2"]) == (1.5, 0.25, 3, 2)


@pytest.mark.parametrize("season,months", [("DJF", [12, 1, 2]), ("JJA", [6, 7, 8]), ("MAM", [3, 4, 5])])
def test_seasons(season, months):
    assert calendar.season_months(season) == months


@pytest.mark.parametrize("season", ["J", "XYZ"])
def test_unknown_seasons(season):
    with pytest.raises(KeyError):
        calendar.season_months(season)


def test_region_edges_are_outside(spark):
    df = spark.createDataFrame([(20.0, 0.0, day(0)), (19.9, 0.0, day(0)), (10.0, 10.0, day(0)), (10.0, 0.0, day(200))], "lat double, lon double, start date")
    assert regions.regional(df, "west_africa").count() == 2
    assert regions.regional(df, "west_africa", "DJF").count() == 1
    assert regions.count_grid(df).count() == 4
    bands = spark.createDataFrame([(x,) for x in (-31.0, -30.0, 0.0, 20.0, 69.9, 70.0)], "lat double")
    assert [r["band"] for r in regions.banded(bands).orderBy("lat").collect()] == ["south1", "south2", "north1", "north2", "north5", "north6"]


def test_nearest_land_cover_year(spark):
    days = [dt.date(2000, 1, 1), dt.date(2000, 12, 31), dt.date(2001, 7, 2), dt.date(1990, 1, 1), dt.date(2030, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", calendar.nearest_stamp_year(F.col("d"), 1999, 2003).alias("y"))
    stamps = {y: dt.date(y, 7, 2) for y in range(1999, 2004)}
    for r in df.collect():
        assert r["y"] == min(stamps, key=lambda y: (abs((stamps[y] - r["d"]).days), y))


def test_land_cover_groups(spark):
    key = spark.createDataFrame([("cropland_rainfed", 10), ("grassland", 130)], "land_cover string, flag int")
    with pytest.raises(KeyError):
        landcover.flags_of(key, "all_cropland_rainfed")
    assert landcover.flags_of(key, "grassland") == [130]
    cover = spark.createDataFrame([(1, 2000, 130), (2, 2000, 10)], "px int, year int, class int")
    rows = spark.createDataFrame([(1, day(0)), (2, day(0))], "px int, day date")
    assert [r["px"] for r in landcover.in_group(rows, cover, key, "grassland").collect()] == [1]
    assert landcover.in_group(rows, cover, key, "all").count() == 2


def test_registry_is_sound():
    for group, names in registry.LAND_COVER_GROUPS.items():
        assert names and all(n == n.strip() for n in names), group
    assert all(v.first_year <= v.last_year and v.column for v in registry.VARIABLES.values())
    assert len(registry.members("all_tree_cover")) == 11
    with pytest.raises(KeyError):
        registry.variable("no such variable")


def test_composites(spark):
    panel = spark.createDataFrame([(1, day(i), float(i), n) for i, n in zip(range(6), [200, 300, 600, 100, 125, 0], strict=True)], "px int, day date, x double, n int")
    ev = spark.createDataFrame([(1, day(0)), (1, day(3))], "px int, start date")
    rows = {r["lag"]: r for r in composite.composite(ev, panel, "x", 2, spread=True).collect()}
    assert (rows[-2]["composite_mean"], rows[-2]["composite_n"]) == (1.0, 1)
    assert (rows[0]["composite_mean"], rows[0]["composite_std"], rows[0]["composite_n"]) == (1.5, 1.5, 2)
    weighted = {r["lag"]: r for r in composite.composite(ev, panel, "x", 2, weight="n", least=125).collect()}
    assert (weighted[0]["composite_mean"], weighted[0]["composite_n"], weighted[0]["composite_total_obs"]) == (0.0, 1, 200.0)
    assert (weighted[1]["composite_mean"], weighted[1]["composite_total_obs"]) == ((300 * 1 + 125 * 4) / 425, 425.0)
    assert (weighted[2]["composite_mean"], weighted[2]["composite_n"]) == (2.0, 1)


def test_enrichment_rules(spark):
    panel = spark.createDataFrame([(1, day(0), 1.0, 200.0), (1, day(1), None, 300.0), (1, day(2), 3.0, 600.0), (1, day(3), None, 5.0), (1, day(4), None, 7.0)], "px int, day date, x double, n double")
    ev = spark.createDataFrame([(1, day(0)), (1, day(2)), (1, day(3))], "px int, start date")
    value = lambda df: {(r["start"] - DAY0).days: r[-1] for r in df.collect()}
    assert value(enrich.add_window(ev, panel, "x", "v", "mean", 0, 2)) == {0: 2.0, 2: None, 3: None}
    assert value(enrich.add_window(ev, panel, "x", "v", "sum", 0, 0)) == {0: 1.0, 2: 3.0, 3: 0.0}
    assert value(enrich.add_window(ev, panel, "x", "v", "max", 0, 0)) == {0: 1.0, 2: 3.0, 3: None}
    got = {(r["start"] - DAY0).days: tuple(r)[-2:] for r in enrich.add_weighted_window(ev, panel, "x", "n", "v", "mean", 0, 2, 125).collect()}
    assert got[0] == (2.5, 1100.0) and got[2] == (None, 0.0)
    top = {(r["start"] - DAY0).days: tuple(r)[-2:] for r in enrich.add_weighted_window(ev, panel, "x", "n", "v", "max", 0, 2, 125).collect()}
    old = {(r["start"] - DAY0).days: tuple(r)[-2:] for r in enrich.add_weighted_window(ev, panel, "x", "n", "v", "max", 0, 2, 125, compat_argmin=True).collect()}
    assert top[0] == (3.0, 600.0) and old[0] == (1.0, 200.0)
    assert enrich.column_name("t2m", "max", 0, 20, True, 5) == "std_anom_t2m_max_0_20_nweighted_smooth5"


def test_quality_limit(spark):
    df = spark.createDataFrame([(1.0, 124.9), (2.0, 125.0)], "v double, n double")
    assert [tuple(r) for r in ingest.least_count(df, "v", "n", 125, True).orderBy("n").collect()] == [(None, 0.0), (2.0, 125.0)]


FIXTURE = {"A": (0, 0, 0, 5), "B": (7, 0, 6, 8), "C": (15, 0, 6, 8), "D": (14, 7, 9, 9), "F": (0, 8, 0, 5)}


def linked(a, b, reach):
    return abs(a[0] - b[0]) <= reach and abs(a[1] - b[1]) <= reach and a[2] <= b[3] + 1 and b[2] <= a[3] + 1


def partition(runs, reach):
    label = list(range(len(runs)))
    for _ in runs:
        for i in range(len(runs)):
            for j in range(len(runs)):
                if linked(runs[i], runs[j], reach):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def run_clusters(spark, runs, reach):
    rows = [(i, r, c, day(s), day(e + 1)) for i, (r, c, s, e) in enumerate(runs)]
    df = spark.createDataFrame(rows, "key bigint, row int, col int, start date, end date")
    return {r["key"]: r["cluster_id"] for r in clusters.cluster(df, reach).collect()}


def test_cluster_fixture(spark):
    got = run_clusters(spark, list(FIXTURE.values()), 7)
    assert [got[i] for i in range(5)] == [0, 0, 0, 0, 4]


@pytest.mark.parametrize("seed", [0, 1])
def test_random_clusters(spark, seed):
    rnd = random.Random(seed)
    runs = [(rnd.randrange(40), rnd.randrange(40), s := rnd.randrange(300), s + rnd.randrange(90)) for _ in range(120)]
    got = run_clusters(spark, runs, 3)
    assert [got[i] for i in range(len(runs))] == partition(runs, 3)


def test_sensitivity_equals_a_loop(spark):
    rnd = random.Random(3)
    n = 200
    m = [rnd.gauss(0, 1) for _ in range(n)]
    x = [None if rnd.random() < 0.3 else rnd.gauss(0, 1) for _ in range(n)]
    panel = spark.createDataFrame([(1, day(i), m[i], x[i]) for i in range(n)], "px int, day date, m double, x double")
    starts = [70, 90, 120]
    ev = spark.createDataFrame([(1, day(s), 0, 0) for s in starts], "px int, start date, box_i int, box_j int")
    for up in (False, True):
        r = sensitivity.sensitivity(ev, panel, "m", "x", ["box_i", "box_j"], least=6, increases=up).first()
        lags = range(-60, 61)
        some = lambda s, k: [s[t + k] for t in starts if 0 <= t + k < n and s[t + k] is not None]
        mean = lambda v: sum(v) / len(v) if v else None
        comp = {c: [(mean(some(s, k)), len(some(s, k))) for k in lags] for c, s in (("m", m), ("x", x))}
        smooth = {}
        for c, v in comp.items():
            smooth[c] = []
            for i in range(len(v)):
                part = v[max(0, i - 2) : i + 3]
                smooth[c].append((mean([a for a, _ in part if a is not None]), sum(k for _, k in part)))
        after = {c: [(a if k >= 6 else None, k) for a, k in v[60:]] for c, v in smooth.items()}
        before = {c: mean([a for a, _ in v[:31] if a is not None]) for c, v in comp.items()}
        low_m = min(a for a, _ in after["m"] if a is not None)
        pick = (max if up else min)((a, -i) if up else (a, i) for i, (a, _) in enumerate(after["x"]) if a is not None)
        assert math.isclose(r["sensitivity"], (pick[0] - before["x"]) / (low_m - before["m"]), rel_tol=1e-9)
        assert r["n"] == after["x"][abs(pick[1])][1]
    assert sensitivity.sensitivity(ev, panel, "m", "x", ["box_i", "box_j"], least=10**6).first()["sensitivity"] is None
    assert sensitivity.on_grid(sensitivity.sensitivity(ev, panel, "m", "x", ["box_i", "box_j"], least=6), 2, 3).count() == 6


def test_bootstrap_is_seeded_and_needs_clusters(spark):
    rnd = random.Random(0)
    df = spark.createDataFrame([(rnd.gauss(0, 1), rnd.gauss(0, 1), i % 12) for i in range(120)], "v double, q double, c int")
    a = sorted(map(tuple, stats.bootstrap(df, "v", "q", "c", 20).collect()))
    assert a == sorted(map(tuple, stats.bootstrap(df.repartition(3), "v", "q", "c", 20).collect())) and len(a) == 20
    flipped = dict(map(tuple, stats.bootstrap(df, "v", "q", "c", 20, reverse=True).collect()))
    assert all(math.isclose(flipped[i], 1 - p) for i, p in a)
    with pytest.raises(ValueError):
        stats.bootstrap(df.filter("c < 9"), "v", "q", "c", 5)


def test_histogram_and_density(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(101)], "v double, g int")
    rows = stats.histogram(df, "v", 20).collect()
    assert sum(r["n"] for r in rows) == 101 and {r["bin"]: r["n"] for r in rows}[19] == 6
    dens = stats.density(df, "v", "g", -300.0, 400.0, 701).collect()
    assert math.isclose(sum(r["density"] for r in dens), 1.0, rel_tol=1e-3)


def test_ingest(spark):
    rows = [(0.0, 0.0, dt.datetime(2000, 1, 2, 6), 1.0), (0.0, 0.0, dt.datetime(2000, 1, 2, 6), 2e10), (81.0, 0.0, dt.datetime(2000, 1, 2), 1.0), (80.0, 180.0, dt.datetime(2000, 1, 2, 13), float("nan"))]
    df = spark.createDataFrame(rows, "lat double, lon double, ts timestamp_ntz, value double")
    got = ingest.apply_rule(df, Variable("v", below=1e10, shift_hours=-12)).collect()
    assert sorted((str(r["day"]), r["value"] is None) for r in got) == [("2000-01-01", False), ("2000-01-01", True), ("2000-01-02", True)]
    assert nulls(df, "value").filter("isnan(value)").count() == 0


def test_regrid_needs_all_corners(spark):
    cells = [(day(0), i, j, float(i * 3 + j)) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "day date, row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in ingest.half_cell_regrid(df).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 3.0, (1, 0): 5.0, (1, 1): 6.0}
    holed = df.withColumn("value", F.when(F.col("row") + F.col("col") > 0, F.col("value")))
    assert {(r["row"], r["col"]): r["value"] for r in ingest.half_cell_regrid(holed).collect()}[0, 0] is None


def test_files(spark, tmp_path):
    df = series(spark, [1, 2, 3]).withColumn("n", F.lit(1))
    path = str(tmp_path / "years")
    ingest.write_years(df, path)
    ingest.write_years(df, path, mode="ignore")
    assert ingest.read_years(spark, path, 2000, 2000, ["px", "v"]).count() == 3
    assert ingest.read_years(spark, path, 2001, 2002, ["px"]).count() == 0
    assert ingest.write_once(df, str(tmp_path / "once")) and not ingest.write_once(df, str(tmp_path / "once"))
    cat = spark.createDataFrame([(1, 1.5, 2.5, day(0), day(20), 20, -1.5, 0.25)], "px int, lat double, lon double, start date, end date, length int, max_intensity double, `std_anom_v_mean_-60_-30` double")
    ingest.write_catalogue_csv(cat, str(tmp_path / "cat"))
    back = ingest.read_catalogue_csv(spark, str(tmp_path / "cat")).first()
    assert (back["lat"], back["start"], back["length"], back["max_intensity"]) == (1.5, day(0), 20, -1.5)
    ingest.write_numbers(spark.createDataFrame([(0.5,), (0.25,)], "p double"), "p", str(tmp_path / "numbers"))
    assert sorted(r["value"] for r in ingest.read_numbers(spark, str(tmp_path / "numbers")).collect()) == [0.25, 0.5]


def test_masks(spark):
    static = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, None)], "px int, land int, rainforest int")
    assert {r["px"] for r in ingest.valid_places(static).collect()} == {1, 4}


def test_grid_arithmetic(spark):
    df = spark.createDataFrame([(-59.875, -179.875), (-59.7, 179.875), (79.875, 0.1)], "lat double, lon double")
    assert [r[0] for r in df.select(grid.pixel_id(F.col("lat"), F.col("lon"))).collect()] == [0, 1440 + 1439, 559 * 1440 + 720]
    tiles = spark.range(10).select(grid.tile_index(F.col("id"), 10, 4).alias("t"), grid.coarse_class(F.col("id") * 13).alias("c")).collect()
    assert [r["t"] for r in tiles] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and tiles[9]["c"] == 110


def test_span_and_densify(spark):
    a, b = series(spark, [1] * 10), series(spark, [1] * 10).filter(F.col("day") >= str(day(4)))
    assert common_span(a, b) == (day(4), day(9))
    places = spark.createDataFrame([(1,), (2,)], "px int")
    assert densify(a, places, "2000-01-01", "2000-01-20").count() == 40


def test_netcdf_source_names_what_it_needs(spark):
    from fluxpanel.sources.netcdf import NetcdfReader, NetcdfSource

    assert NetcdfSource.name() == "netcdf_panel"
    pytest.importorskip  # the library may be there
    try:
        import netCDF4  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            NetcdfReader._open("x.nc")
