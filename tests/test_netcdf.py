"""Classic NetCDF files: headers of all kinds, filters that skip files, files that take their places together or not at all."""

import datetime as dt
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxpanel.sources import classic

GRID = {"variable": "v", "south": "-1", "west": "10", "step": "0.5", "rows": "4", "cols": "3", "units": "mm", "prefix": "rain"}


def pad(raw):
    return raw + b"\0" * (-len(raw) % 4)


def name(n):
    return struct.pack(">i", len(n)) + pad(n.encode())


def record_file(path, version=1, streaming=False, lats=(1.0, 0.5), lons=(7.0, 8.0, 9.0), hours=(0, 30, 49), second=True):
    """A file made by hand: time is the record dimension, values are scaled shorts, latitudes descend, a second variable lies between the records."""
    data = (np.arange(len(hours) * len(lats) * len(lons)) % 7).reshape(len(hours), len(lats), len(lons)).astype(">i2")
    data[0, 0, 0] = -9
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
    number = lambda k, v: name(k) + struct.pack(">ii", 6, 1) + struct.pack(">d", v)
    short = lambda k, v: name(k) + struct.pack(">ii", 3, 1) + pad(struct.pack(">h", v))
    off = ">i" if version == 1 else ">q"
    fixed = len(lats) * 4 + len(lons) * 8
    cells, kinds = len(lats) * len(lons) * 2, [("time", [2], text("units", "hours since 2001-12-31 00:00:00"), 1, 6, 8)]
    kinds.append(("x", [2, 0, 1], number("scale_factor", 0.5) + number("add_offset", 10.0) + short("_FillValue", -9), 3, 3, cells + -cells % 4))
    if second:
        kinds.append(("flag", [2], b"", 0, 1, 4))
    heads = [name("lat") + struct.pack(">iii", 1, 0, 0) + struct.pack(">i", 0) + struct.pack(">ii", 5, len(lats) * 4), name("lon") + struct.pack(">iii", 1, 1, 0) + struct.pack(">i", 0) + struct.pack(">ii", 6, len(lons) * 8)]
    for n, dims, attrs, _, kind, size in kinds:
        count = {"time": 1, "x": 3, "flag": 0}[n]
        heads.append(name(n) + struct.pack(f">{1 + len(dims)}i", len(dims), *dims) + struct.pack(">ii", 12 if count else 0, count) + attrs + struct.pack(">ii", kind, size))
    top = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streaming else len(hours)) + struct.pack(">ii", 10, 3) + b"".join(name(n) + struct.pack(">i", k) for n, k in (("lat", len(lats)), ("lon", len(lons)), ("time", 0))) + struct.pack(">ii", 12, 1) + text("title", "by hand") + struct.pack(">ii", 11, len(heads))
    begin = len(top) + sum(len(h) + struct.calcsize(off) for h in heads)
    places = [begin, begin + len(lats) * 4, *np.cumsum([begin + fixed] + [k[5] for k in kinds[:-1]]).tolist()]
    body = np.array(lats, ">f4").tobytes() + np.array(lons, ">f8").tobytes()
    for t, h in enumerate(hours):
        body += struct.pack(">d", h) + pad(data[t].tobytes()) + (pad(b"\1") if second else b"")
    path.write_bytes(top + b"".join(h + struct.pack(off, p) for h, p in zip(heads, places, strict=True)) + body)
    stamp = [dt.datetime(2001, 12, 31) + dt.timedelta(hours=h) for h in hours]
    return {(lat, lon, stamp[t]): None if data[t, i, j] == -9 else 10 + 0.5 * float(data[t, i, j]) for t in range(len(hours)) for i, lat in enumerate(lats) for j, lon in enumerate(lons)}


@pytest.fixture
def source(spark):
    spark.dataSource.register(classic.ClassicSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("netcdf_classic").option("variable", "x")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("version,streaming,second", [(1, False, True), (2, True, True), (1, True, False)])
def test_files_with_records_are_read(source, tmp_path, version, streaming, second):
    want = record_file(tmp_path / "a.nc", version, streaming, second=second)
    got = {(r["lat"], r["lon"], r["ts"]): r["value"] for r in source.option("split", 100).load(str(tmp_path / "a.nc")).collect()}
    assert got == want
    south = source.load(f"{tmp_path}/*.nc").filter("lat < 0.7 and ts >= timestamp_ntz'2002-01-01'")
    assert {(r["lat"], r["lon"], r["ts"]): r["value"] for r in south.collect()} == {k: v for k, v in want.items() if k[0] == 0.5 and k[2].year == 2002}


def test_other_files_are_refused(source, tmp_path):
    (tmp_path / "a.nc").write_bytes(b"\x89HDF and more")
    with pytest.raises(Exception, match="classic"):
        source.load(str(tmp_path / "a.nc")).collect()
    with pytest.raises(ValueError, match="calendar"):
        classic.times(np.zeros(1), "days since 2000-01-01", "noleap")
    assert classic.times(np.array([1.5]), "days since 1970-1-1", "standard").tolist() == [129_600_000_000]


def cells(spark, years):
    days = spark.createDataFrame([(dt.datetime(y, 1, 1),) for y in years], "d timestamp").select(F.explode(F.sequence(F.to_date("d"), F.make_date(F.year("d"), F.lit(12), F.lit(31)))).alias("day"))
    grid = spark.range(12).selectExpr("id div 3 as i", "id % 3 as j")
    rows = days.crossJoin(grid).filter("(i + j + day(day)) % 5 > 0").selectExpr("cast(day as timestamp_ntz) as ts", "-0.75 + i * 0.5D as lat", "10.25 + j * 0.5D as lon", "if(i = 2, null, cast(unix_date(day) % 97 + i * 10 + j as double)) as value", "year(day) as year")
    return rows


def save(rows, path, mode="append", **more):
    rows.repartition("year").sortWithinPartitions("ts").drop("year").write.format("netcdf_classic").options(**GRID, **more).mode(mode).save(str(path))


def test_written_years_are_read_back_and_filters_skip_files(spark, source, tmp_path):
    rows = cells(spark, [2000, 2001, 2002, 2003])
    save(rows, tmp_path / "out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"rain_{y}.nc" for y in range(2000, 2004)]
    back = spark.read.format("netcdf_classic").option("variable", "v").load(str(tmp_path / "out"))
    key = lambda r: (r["lat"], r["lon"], r["ts"])
    want = {key(r): r["value"] for r in rows.collect()}
    got = {key(r): r["value"] for r in back.collect()}
    assert len(got) == 12 * 1461 and all(got[k] == v for k, v in want.items()) and all(v is None for k, v in got.items() if k not in want)
    late = back.filter("ts >= timestamp_ntz'2002-05-01'")
    assert back.rdd.getNumPartitions() == 4 and late.rdd.getNumPartitions() == 2
    assert late.count() == sum(k[2] >= dt.datetime(2002, 5, 1) for k in got)
    assert back.filter("ts > timestamp_ntz'2010-01-01'").count() == 0
    head = classic.read_header(open(tmp_path / "out/rain_2001.nc", "rb"), os.path.getsize(tmp_path / "out/rain_2001.nc"))
    assert head.variables["v"].attrs["units"] == "mm" and head.names == ["lat", "lon", "time"] and head.lengths == [4, 3, 365]
    # a year again: an error, or in place of the one that is there
    with pytest.raises(Exception, match="rain_2001"):
        save(rows.filter("year = 2001"), tmp_path / "out")
    save(rows.filter("year = 2001").withColumn("value", F.lit(1.0)), tmp_path / "out", "overwrite")
    assert {r["value"] for r in back.filter("year(ts) = 2001").collect()} == {1.0, None} and back.filter("year(ts) = 2000 and value is not null").count() == sum(v is not None for k, v in want.items() if k[2].year == 2000)


def test_a_failure_leaves_no_file(spark, source, tmp_path):
    rows = cells(spark, [2000, 2001])
    bad = rows.withColumn("lat", F.when(F.col("ts") == F.lit("2001-11-01").cast("timestamp_ntz"), 80.0).otherwise(F.col("lat")))
    with pytest.raises(Exception, match="outside of the grid"):
        save(bad, tmp_path / "out")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="order of time|deal the rows"):
        rows.repartition(5, "lon").sortWithinPartitions(F.col("ts").desc()).drop("year").write.format("netcdf_classic").options(**GRID).mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*.nc"))
    save(rows.limit(0), tmp_path / "none")
    assert not list((tmp_path / "none").glob("*.nc"))
