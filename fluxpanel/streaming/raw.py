"""Events from a stream of raw values, with all windows kept in each place's state.

A row is a value of a place and time, with the climatology of its calendar day. Values of one day are summed within each task, then by place and day, so that
one row of a place and day comes to the state from a micro-batch however many values there are; the state adds those of several, until the watermark closes the day. The state keeps the last ``TAIL`` closed days as they are: the 5-day and 30-day means, the least
values of the 20 days ahead and the 61 days around are taken from them, with the frames, least counts and rounding of the batch features, when the
30 days ahead and two for smoothing are closed too. Then the day is judged, and an event is emitted once the day that ends it is.

Event-time timers close days of places that get no new rows, as long as a place has anything that may still change. A row of a closed day is late and
left out, as Spark does with rows behind the watermark. Days without values are missing ones, before a place's first row too, so a stream gives the
rows that the batch gives. With ``last`` the record ends there: once the watermark has passed it, days after it are no part of any window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import Rule

#: Days that a day's windows look ahead, and closed days that are kept.
AHEAD, TAIL = 32, 64
DAY_MS = 86_400_000
#: Rows that a task holds at most while it sums them.
HELD = 1 << 19
FIELDS = ["day", "total", "n", "t_total", "t_n", "clim_mean", "clim_std"]
OPEN = "array<struct<day:int,total:double,n:bigint,t_total:double,t_n:bigint,clim_mean:double,clim_std:double>>"
#: Last closed day, values of the last closed days, sums of the open ones, and the event under way (its first day, -1: none).
STATE = f"upto int, z array<double>, t array<double>, open {OPEN}, armed boolean, begun int, lowest double"
NEEDED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def together(parts: list) -> pa.Table:
    """One row for each place and day of the given sums."""
    t = pa.Table.from_batches(parts)
    how = [(c, "min" if c.startswith("clim") else "sum") for c in t.column_names[2:]]
    return t.group_by(["px", "day"], use_threads=False).aggregate(how).select(["px", "day", *["_".join(x) for x in how]]).rename_columns(t.column_names)


def summed(batches):
    """Sums of each place and day over all rows of a task. Places and days that are more than half of ``HELD`` are given out between and may come again."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < HELD:
            continue
        held = together(held).combine_chunks().to_batches(max_chunksize=HELD // 8)
        rows = sum(x.num_rows for x in held)
        if rows > HELD // 2:
            yield from held
            held, rows = [], 0
    if held:
        yield from together(held).to_batches(max_chunksize=HELD // 8)


def day_sums(batches):
    """The same of raw rows."""
    there = lambda b, c: pc.is_valid(b.column(c)).cast(pa.int64())
    names = ["px", *FIELDS]

    def ones():
        for b in batches:
            cols = [b.column("px"), b.column("day"), b.column("value"), there(b, "value"), b.column("t"), there(b, "t"), *b.columns[4:]]
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return summed(ones())


def sliding(x: np.ndarray, before: int, after: int, fn: str, least: int = 1) -> np.ndarray:
    """Mean or least value of the frame around each place, where it has ``least`` values or more; NaN is missing."""
    wide = np.concatenate([np.full(before, np.nan), x, np.full(after, np.nan)])
    view = np.lib.stride_tricks.sliding_window_view(wide, before + after + 1)
    there = ~np.isnan(view)
    n = there.sum(1)
    got = np.where(there, view, 0.0).sum(1) / np.maximum(n, 1) if fn == "mean" else np.where(there, view, np.inf).min(1)
    return np.where(n >= least, got, np.nan)


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    return np.array([v if v != v else round(v, digits) for v in x.tolist()])


class Place:
    """The state of one place, while days are closed."""

    def __init__(self, rule: Rule, first: int, last: int | None, state: tuple | None):
        self.rule, self.first, self.last = rule, first, last
        self.upto, z, t, held, self.armed, self.begun, self.lowest = state or (first - 1, [], [], [], False, -1, 0.0)
        self.z, self.t = (np.array([np.nan if v is None else v for v in x], float) for x in (z, t))
        self.open = {r[0]: list(r[1:]) for r in held}

    def add(self, rows: pd.DataFrame) -> None:
        """Sums of open days; those of closed days are late, and days outside of the record are no part of it."""
        for day, total, n, t_total, t_n, mean, std in rows[FIELDS].itertuples(index=False):
            if day <= self.upto or day < self.first or (self.last is not None and day > self.last) or not (n or t_n):
                continue
            held = self.open.setdefault(int(day), [0.0, 0, 0.0, 0, None, None])
            for k, (v, c) in ((0, (total, n)), (2, (t_total, t_n))):
                if c:
                    held[k] += float(v)
                    held[k + 1] += int(c)
            held[4:] = [None if pd.isna(x) else float(x) for x in (mean, std)]

    def close(self, upto: int) -> list[tuple]:
        """Closes all days up to one; (start, end, least value) of the events that are final by that."""
        ended = self.last is not None and upto >= self.last
        if ended:
            upto = self.last
        if upto <= self.upto:
            return []
        days = upto - self.upto
        z, t = np.full(days, np.nan), np.full(days, np.nan)
        for day in [d for d in self.open if d <= upto]:
            total, n, t_total, t_n, mean, std = self.open.pop(day)
            if n and mean is not None and std is not None:
                z[day - self.upto - 1] = (total / n - mean) / std
            if t_n:
                t[day - self.upto - 1] = t_total / t_n
        low = self.upto - len(self.z) + 1  # the day of the first value that is kept
        judged = self.upto - AHEAD  # the last day judged before
        z, t = np.concatenate([self.z, z]), np.concatenate([self.t, t])
        out = self.judge(z, t, low, max(judged + 1, self.first), upto if ended else upto - AHEAD)
        self.upto, self.z, self.t = upto, z[-TAIL:], t[-TAIL:]
        return out

    def judge(self, z: np.ndarray, t: np.ndarray, low: int, begin: int, end: int) -> list[tuple]:
        """Runs the rule over the days from ``begin`` to ``end``; the arrays begin with day ``low``."""
        if end < begin:
            return []
        p, b, warm = rounded(sliding(z, 2, 2, "mean", 2)), rounded(sliding(z, 29, 0, "mean", 5)), rounded(sliding(t, 2, 2, "mean", 1))
        a, c = sliding(np.append(p[1:], np.nan), 0, 19, "min"), sliding(warm, 30, 30, "min")
        starts = (b > self.rule.prior) & (a < self.rule.after)
        if self.rule.frozen is not None:
            starts &= ~(c < self.rule.frozen)
        out = []
        for day, x, start in zip(range(begin, end + 1), p[begin - low : end - low + 1].tolist(), starts[begin - low : end - low + 1].tolist(), strict=True):
            if x < self.rule.below:
                if self.begun >= 0:
                    self.lowest = min(self.lowest, x)
                elif self.armed:
                    self.begun, self.lowest = day, x
                self.armed = False
            elif self.begun >= 0:
                if day - self.begun >= self.rule.min_days:
                    out.append((self.begun, day, self.lowest))
                self.begun = -1
            self.armed = self.armed or start
        return out

    def waiting(self) -> bool:
        """Whether days without values could still change anything."""
        if self.last is not None and self.upto >= self.last:
            return False
        return bool(self.open) or self.begun >= 0 or not bool(np.isnan(self.z).all())

    def state(self) -> tuple:
        number = lambda x: [None if v != v else v for v in x.tolist()]
        return self.upto, number(self.z), number(self.t), [(d, *v) for d, v in sorted(self.open.items())], self.armed, self.begun, self.lowest


class RawEvents(StatefulProcessor):
    def __init__(self, rule: Rule, first: int, last: int | None):
        self.rule, self.first, self.last = rule, first, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("place", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place = self.place()
        for part in rows:
            place.add(part)
        yield self.closed(key, place, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.closed(key, self.place(), timerValues)

    def close(self) -> None:
        pass

    def place(self) -> Place:
        return Place(self.rule, self.first, self.last, self.held.get() if self.held.exists() else None)

    def closed(self, key, place: Place, timers) -> pd.DataFrame:
        mark = timers.getCurrentWatermarkInMs()
        found = place.close(mark // DAY_MS - 1)
        self.held.update(place.state())
        if place.waiting():
            self.handle.registerTimer(max((place.upto + 2) * DAY_MS, mark + 1))
        out = pd.DataFrame(found, columns=["s", "e", "max_intensity"])
        date = lambda c: pd.to_datetime(out[c].astype("int64"), unit="D").dt.date
        return pd.DataFrame({"px": [key[0]] * len(out), "start": date("s"), "end": date("e"), "length": (out["e"] - out["s"]).astype("int32"), "max_intensity": out["max_intensity"].astype("float64")})


def daily_sums(rows: DataFrame, climatology: DataFrame | None = None) -> DataFrame:
    """px and FIELDS of raw rows, as ``detect_raw`` takes them: a row for each place and day, unless a task has more of them than it may hold."""
    kind = dict(rows.dtypes)["px"]
    cols = ["value", "t"] if climatology is not None else ["value", "t", "clim_mean", "clim_std"]
    narrow = rows.filter("px is not null and ts is not null").select("px", F.unix_date(F.to_date("ts")).alias("day"), *[F.col(c).cast("double").alias(c) for c in cols])
    kinds = f"px {kind}, day int, total double, n bigint, t_total double, t_n bigint" + "".join(f", {c} double" for c in cols[2:])
    sums = narrow.mapInArrow(day_sums, kinds).repartition("px", "day").mapInArrow(summed, kinds)
    if climatology is not None:
        sums = sums.withColumn("md", F.date_format(F.date_from_unix_date("day"), "MM-dd")).join(climatology, ["px", "md"], "left").select("px", *FIELDS)
    return sums


def detect_raw(rows: DataFrame, first, last=None, rule: Rule = Rule(), delay: str = "0 days", climatology: DataFrame | None = None) -> DataFrame:
    """px, start, end, length, max_intensity of a stream of px, ts, value, t (a temperature, may be null), clim_mean and clim_std.

    ``first`` is the record's first day (a date), ``last`` its last one, if it has one; ``delay`` how far behind the latest row others may come. Rows without
    a place or time are left out; one without values only moves the time on. Repeated rows count twice, as in the batch. With a ``climatology`` of px, md,
    clim_mean and clim_std the rows need not have the last two: the days' sums are joined with it. The session needs the settings of ``NEEDED`` when the stream starts.
    """
    epoch = pd.Timestamp(0).date()
    kind = dict(rows.dtypes)["px"]
    timed = daily_sums(rows, climatology).withColumn("ts", F.timestamp_seconds(F.col("day").cast("bigint") * 86400)).withWatermark("ts", delay)
    days = lambda d: None if d is None else (d - epoch).days
    return timed.groupBy("px").transformWithStateInPandas(RawEvents(rule, days(first), days(last)), f"px {kind}, start date, end date, length int, max_intensity double", "Append", "EventTime")
