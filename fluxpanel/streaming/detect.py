"""Event detection on a stream of daily features, with a few bytes of state for each place.

The same rule as the batch operator: a start arms the place; the first low day after it begins an event, and the first day
that is not low ends it. Rows of a place count in day order; a row for a day that is not after the last one seen is late
and left out, so a stream must bring each place's days in order, as a daily feed does. Features look up to 30 days ahead,
so the stream of features runs that far behind the observations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import Rule, is_start

OUTPUT = "px int, start date, end date, length int, max_intensity double"
#: armed, first day of the event under way, least value since then, last day seen (days since 1970, -1: none)
STATE = "armed boolean, begun int, lowest double, last int"


def step(state: tuple, day: int, p: float | None, starts: bool, rule: Rule) -> tuple[tuple, tuple | None]:
    """(new state, event that ended) after one day."""
    armed, begun, lowest, last = state
    if day <= last:
        return state, None
    ended = None
    if p is not None and p < rule.below:
        if armed and begun < 0:
            begun, lowest = day, p
        elif begun >= 0:
            lowest = min(lowest, p)
        armed = False
    elif begun >= 0:
        if day - begun >= rule.min_days:
            ended = (begun, day, lowest)
        begun, lowest = -1, 0.0
    return (armed or starts, begun, lowest, day), ended


def detect_stream(features: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Streaming catalogue of px, day, p, b, a, c features: an event is emitted on the day after its last one."""
    rows = features.select("px", F.unix_date("day").alias("day"), "p", is_start(rule).alias("starts"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (False, -1, 0.0, -1)
        out = []
        for day, p, starts in pd.concat(list(batches)).sort_values("day")[["day", "p", "starts"]].itertuples(index=False):
            now, ended = step(now, int(day), None if pd.isna(p) else float(p), bool(starts), rule)
            if ended:
                out.append((key[0], *ended))
        state.update(now)
        found = pd.DataFrame(out, columns=["px", "s", "e", "max_intensity"])
        days = lambda c: (pd.to_datetime(found[c].astype("int64"), unit="D")).dt.date
        yield pd.DataFrame({"px": found["px"].astype("int32"), "start": days("s"), "end": days("e"), "length": (found["e"] - found["s"]).astype("int32"), "max_intensity": found["max_intensity"].astype("float64")})

    return rows.groupBy("px").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
