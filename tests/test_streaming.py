"""The streaming detector against the batch operator, over several triggers."""

import datetime as dt
import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from fluxpanel.operators import events
from fluxpanel.operators.events import Rule
from fluxpanel.plans.panel import densify
from fluxpanel.streaming import raw
from fluxpanel.streaming.detect import detect_stream


def test_stream_equals_batch(spark, tmp_path):
    rnd, rows = random.Random(5), []
    rule = Rule(prior=-0.25, after=-0.6, below=-0.6, min_days=5)
    for px in range(8):
        x = 0.0
        for i in range(200):
            x = 0.95 * x + rnd.gauss(0, 0.35)
            rows.append((px, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if rnd.random() < 0.1 else x, rnd.choice([0.0, -1.0]), rnd.choice([-1.0, 0.0]), rnd.choice([None, 270.0, 290.0])))
    schema = "px int, day date, p double, b double, a double, c double"
    for k in range(4):
        part = [r for r in rows if (r[1] - dt.date(2000, 1, 1)).days // 50 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = detect_stream(stream, rule).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    df = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in events.catalogue(events.intervals(df, rule), df).collect()}
    got = {tuple(r) for r in spark.table("found").collect()}
    assert want and got == want


FIRST, LAST = dt.date(2000, 1, 1), dt.date(2000, 9, 26)
LOW = Rule(prior=-0.25, after=-0.6, below=-0.6, min_days=5, frozen=278.15)


def raw_rows(seed=7, places=8, days=270):
    """px, ts, value, t, clim_mean, clim_std by day; some days have several values, some none; place 7 ends early."""
    rnd, rows = random.Random(seed), []
    for px in range(places):
        x = 0.0
        for i in range(days if px < 7 else 120):
            x = 0.9 * x + rnd.gauss(0, 0.6)
            for _ in range(rnd.choice([0, 1, 1, 1, 3])):
                ts = dt.datetime(2000, 1, 1) + dt.timedelta(days=i, hours=rnd.randrange(24))
                rows.append((px, ts, 10 + 2 * (x + rnd.gauss(0, 0.3)), 270.0 if px % 2 == 0 and 100 <= i < 105 else rnd.choice([None, 281.0, 284.0]), 10.0, 2.0))
    return rows


RAW = "px int, ts timestamp, value double, t double, clim_mean double, clim_std double"


def batch_events(spark, rows, last):
    """The batch's catalogue of the daily means."""
    days = spark.createDataFrame(rows, RAW).groupBy("px", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.avg("t").alias("t"))
    places = days.select("px").distinct()
    panel = densify(days, places, str(FIRST), str(last)).withColumn("z", (F.col("v") - 10.0) / 2.0)
    feats = events.features(panel)
    found = events.catalogue(events.intervals(feats, LOW), feats)
    return {tuple(r) for r in found.withColumn("max_intensity", F.round("max_intensity", 6)).collect()}


def started(spark, path, last=None, delay="3 days", files=1):
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(str(path / "in"))
    found = raw.detect_raw(stream, FIRST, last, LOW, delay)
    for k, v in raw.NEEDED.items():
        spark.conf.set(k, v)
    return found.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "mark"))


def written(spark, path):
    rows = [tuple(r) for r in spark.read.schema("px int, start date, end date, length int, max_intensity double").parquet(str(path / "out")).withColumn("max_intensity", F.round("max_intensity", 6)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def put(spark, path, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(str(path / "in"))


def weeks(rows, size=30):
    """The rows by stretches of time, shuffled within them."""
    out = {}
    for r in rows:
        out.setdefault((r[1].date() - FIRST).days // size, []).append(r)
    for part in out.values():
        random.Random(1).shuffle(part)
    return [out[k] for k in sorted(out)]


def test_raw_stream_equals_batch_and_a_stopped_one_loses_and_repeats_nothing(spark, tmp_path):
    rows = raw_rows()
    for part in weeks(rows):
        put(spark, tmp_path, part)
    query = started(spark, tmp_path).start()
    while not (query.lastProgress and query.lastProgress["batchId"] >= 2):  # stopped in the middle
        time.sleep(0.1)
    query.stop()
    early = written(spark, tmp_path)
    query = started(spark, tmp_path).trigger(availableNow=True).start()
    query.awaitTermination()
    latest = max(r[1] for r in rows).date()
    shut = latest - dt.timedelta(days=3 + 33)
    final = {e for e in batch_events(spark, rows, LAST) if e[2] <= shut}
    got = written(spark, tmp_path)
    assert got == final and early < got and {e[0] for e in got} > {7}
    # a row of nothing but a later time: the record is whole, and everything is final
    put(spark, tmp_path, [(0, dt.datetime(2001, 3, 1), None, None, None, None), (99, dt.datetime(2001, 3, 1), None, None, None, None)])
    started(spark, tmp_path).trigger(availableNow=True).start().awaitTermination()
    assert {e for e in written(spark, tmp_path) if e[2] <= shut} == final


def test_raw_stream_with_an_end_gives_the_batch_rows_and_leaves_late_rows_out(spark, tmp_path):
    rows = raw_rows(seed=11)
    parts = weeks(rows)
    for part in parts[:5]:
        put(spark, tmp_path, part)
    late = [(px, dt.datetime(2000, 2, 3), 100.0, 284.0, 10.0, 2.0) for px in range(8)]  # behind the watermark: they would change the means
    put(spark, tmp_path, late)
    for part in parts[5:]:
        put(spark, tmp_path, part)
    put(spark, tmp_path, [(0, dt.datetime.combine(LAST, dt.time()) + dt.timedelta(days=10), 5.0, None, 10.0, 2.0), (None, dt.datetime(2000, 1, 1), 1.0, None, 10.0, 2.0), (1, None, 1.0, None, 10.0, 2.0)])
    started(spark, tmp_path, LAST).trigger(availableNow=True).start().awaitTermination()
    want = batch_events(spark, rows, LAST)
    assert written(spark, tmp_path) == want and any(e[2] > LAST - dt.timedelta(days=32) for e in want)


def test_one_row_of_a_place_and_day_comes_to_the_state(spark, monkeypatch):
    """However many values, batches and tasks there are; with sums that are more than a task may hold some come again, and nothing is lost."""
    rnd = random.Random(4)
    rows = [(px, dt.datetime(2000, 1, 1) + dt.timedelta(days=rnd.randrange(40)), rnd.choice([None, rnd.random()]), rnd.choice([None, 280.0]), px + 1.0, 2.0) for _ in range(6000) for px in range(3)]
    want = {}
    for px, ts, v, t, mean, std in rows:
        x = want.setdefault((px, (ts.date() - dt.date(1970, 1, 1)).days), [0.0, 0, 0.0, 0, mean, std])
        for k, y in ((0, v), (2, t)):
            x[k] += y or 0.0
            x[k + 1] += y is not None

    def same(got):
        assert got.keys() == want.keys()
        assert all(abs(g - w) < 1e-6 for k in want for g, w in zip(got[k], want[k], strict=True))

    df = spark.createDataFrame(rows, RAW).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = [tuple(r) for r in raw.daily_sums(df).collect()]
        clim = df.select("px", F.date_format("ts", "MM-dd").alias("md"), "clim_mean", "clim_std").distinct()
        joined = [tuple(r) for r in raw.daily_sums(df.drop("clim_mean", "clim_std"), clim).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(joined) == len(want) == 120
    same({r[:2]: r[2:] for r in found})
    same({r[:2]: r[2:] for r in joined})
    epoch = dt.datetime(1970, 1, 1)
    table = pa.table([[(r[k] - epoch).days if k == 1 else r[k] for r in rows] for k in range(6)], ["px", "day", "value", "t", "clim_mean", "clim_std"])
    assert sum(b.num_rows for b in raw.day_sums(table.to_batches(max_chunksize=100))) == 120
    for held in (64, 200, 300):
        monkeypatch.setattr(raw, "HELD", held)
        got = {}
        parts = list(raw.day_sums(table.to_batches(max_chunksize=50)))
        assert max(b.num_rows for b in parts) <= held
        for r in (r for b in parts for r in zip(*[c.to_pylist() for c in b.columns], strict=True)):
            x = got.setdefault(r[:2], [0.0, 0, 0.0, 0, *r[6:]])
            for k in range(4):
                x[k] += r[2 + k] or 0
        same(got)
    assert not [b for b in raw.day_sums(table.slice(0, 0).to_batches()) if b.num_rows]


def test_places_are_closed_in_any_steps():
    """The same days closed at once, one by one and in uneven steps give the same events; the state stays small."""
    rows = [(int((r[1].date() - dt.date(1970, 1, 1)).days), *r) for r in raw_rows(seed=3, places=1)]
    days = pd.DataFrame([(d, v, 1, t or 0.0, int(t is not None), m, s) for d, _, _, v, t, m, s in rows], columns=raw.FIELDS)
    first = (FIRST - dt.date(1970, 1, 1)).days
    outs = []
    for step in (400, 1, 7, 50):
        place, out = raw.Place(LOW, first, first + 269, None), []
        for upto in range(first, first + 400, step):
            new = days[(days["day"] > upto - step) & (days["day"] <= upto)]
            place.add(new)
            out += place.close(upto)
            assert len(place.z) <= raw.TAIL and len(place.open) <= 1
            place = raw.Place(LOW, first, first + 269, place.state())
        place.add(days)
        outs.append(out + place.close(first + 400))
    assert outs[1] and all(o == outs[1] for o in outs[1:])
    whole = raw.Place(LOW, first, first + 269, None)
    whole.add(days)
    assert whole.close(first + 269) == outs[1] and not whole.waiting()
