"""Best-fit packing by the configuration linear program over the length histogram.

The histogram has at most ``capacity`` lengths whatever the corpus. The program (how often to use each multiset of lengths
that fits a sequence, so that every length is used up) is solved by multiplicative weights: each round prices the lengths,
a knapsack dynamic program finds the best configurations, and the weights of what they use fall; each phase of such rounds multiplies the
prices of lengths that ended in sequences of little worth. Rounded down, that leaves
a rest that is packed by configurations too: the longest piece left, then the longest that still fits, used as often as
the counts allow. All of it works on counts; pieces are dealt to places by their rank among the pieces of their length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_value, written
from .tokens import encoder

CAPACITY = 1024


def best_values(value: np.ndarray, capacity: int) -> np.ndarray:
    """Greatest value of a multiset of lengths within each room from 0 to the capacity (unbounded knapsack); ``value`` is by length."""
    back, room = np.zeros(capacity + 1), np.empty(capacity)
    for c in range(1, capacity + 1):
        gain = np.add(back[capacity - c + 1 :], value[1 : c + 1], out=room[:c])
        back[capacity - c] = max(gain.max(), back[capacity - c + 1])
    return back[::-1]


def best_configuration(best: np.ndarray, value: np.ndarray, first: int, capacity: int, count: np.ndarray) -> dict[int, int]:
    """Multiset of lengths within the capacity and the counts, of the greatest value among those with ``first``; the longest length where several are as good.

    The table knows no counts: where a length runs out, the walk goes on with the best of the others.
    """
    out, room = {first: 1}, capacity - first
    free = value if count[first] > 1 else np.where(np.arange(capacity + 1) == first, -np.inf, value)
    while room > 0:
        if best[room] <= best[room - 1]:
            room -= 1
            continue
        worth = best[:room] + free[room:0:-1]
        v = room - int(worth.argmax())
        if worth[room - v] == -np.inf:
            break
        out[v] = out.get(v, 0) + 1
        room -= v
        if out[v] >= count[v]:
            free = np.where(np.arange(capacity + 1) == v, -np.inf, free)
    return out


def first_prices(capacity: int, power: float = 1.005) -> np.ndarray:
    """In proportion to length, the dual solution where sequences can be filled, a little more for long pieces so that short ones last."""
    return np.arange(capacity + 1.0) ** power


def fractional(count: np.ndarray, capacity: int, rounds: int | None = None, base: np.ndarray | None = None, step: float = 0.1, rate: float = 0.1, near: float = 0.02) -> dict[tuple, float]:
    """Configuration -> how often, for the program that uses each length up: one phase, at prices that start from ``base`` and fall with what is left of a length.

    A round takes, from one knapsack table, configurations without a common length that are worth
    1 - ``near`` of the best or more, each for ``step`` of its scarcest length or once; a length that is used up leaves the program.
    It ends when all are, unless ``rounds`` ends it before.
    """
    n, base = count.astype(float), first_prices(capacity) if base is None else base
    left, lengths, found = n.copy(), np.flatnonzero(count), {}
    done = 0
    while len(lengths) and done != rounds:
        done += 1
        price = np.full(capacity + 1, -np.inf)
        price[lengths] = base[lengths] * np.exp(rate * left[lengths] / n[lengths])
        best = best_values(price, capacity)
        worth = price[lengths] + best[capacity - lengths]
        order = np.lexsort((-lengths, -worth))
        taken = np.zeros(capacity + 1, bool)
        for v in lengths[order[worth[order] >= (1 - near) * best[capacity]]].tolist():
            if taken[v]:
                continue
            config = best_configuration(best, price, v, capacity, count)
            ix = np.array(list(config))
            if taken[ix].any():
                continue
            a = np.array(list(config.values()), float)
            times = min(max(step * (n[ix] / a).min(), 1.0), (left[ix] / a).min())
            key = tuple(sorted(config.items(), reverse=True))
            found[key] = found.get(key, 0.0) + times
            left[ix] -= times * a
            taken[ix] = True
        lengths = lengths[left[lengths] > 1e-9 * n[lengths]]
    return found


def repriced(base: np.ndarray, found: dict[tuple, float], count: np.ndarray) -> np.ndarray:
    """Prices for the next phase: each times the mean of 1 / worth of the sequences that its length is in.

    Lengths that end in sequences of little worth get dearer. Where all sequences are worth the same, prices stay, and are the program's dual solution.
    """
    share = np.zeros(len(base))
    for config, times in found.items():
        worth = sum(base[v] * m for v, m in config)
        for v, m in config:
            share[v] += times * m / worth
    out, ix = base.copy(), np.flatnonzero((count > 0) & (share > 0))
    out[ix] *= share[ix] / count[ix] * (count[ix] @ base[ix]) / (share[ix] @ base[ix])
    return out


def least(count: np.ndarray, capacity: int, base: np.ndarray) -> int:
    """A number of sequences that no packing goes below, by volume and by the prices as a dual solution."""
    if not count.any():
        return 0
    worth = best_values(np.where(count > 0, base, -np.inf), capacity)[capacity]
    return math.ceil(max(count @ np.arange(capacity + 1) / capacity, count @ base / worth) * (1 - 1e-9))


def greedy(count: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Configurations that use up the counts: the longest left, then the longest that fits, as often as they last."""
    left, out = count.copy(), []
    alive = [int(v) for v in np.flatnonzero(left)]
    while alive:
        room, config, at = capacity, {}, len(alive) - 1
        while room and at >= 0:
            at = min(at, int(np.searchsorted(alive, room, "right")) - 1)
            if at < 0:
                break
            v = alive[at]
            m = min(room // v, int(left[v]))
            config[v] = m
            room -= m * v
            at -= 1
        times = min(int(left[v]) // m for v, m in config.items())
        out.append((tuple(config.items()), times))
        for v, m in config.items():
            left[v] -= m * times
        alive = [v for v in alive if left[v]]
    return out


def rounded_down(count: np.ndarray, found: dict[tuple, float]) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """([(configuration, times)] rounded down, what they leave of the histogram)."""
    left, out = count.copy(), []
    for config, times in sorted(found.items(), key=lambda x: -x[1] * sum(v * m for v, m in x[0])):
        k = min([int(times + 1e-6), *(int(left[v]) // m for v, m in config)])
        if k > 0:
            out.append((config, k))
            for v, m in config:
                left[v] -= m * k
    return out, left


def program(count: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None, phases: int = 10, gap: float = 0.0005) -> tuple[list[tuple[tuple, int]], np.ndarray, list[tuple[tuple, int]]]:
    """([(configuration, times)] of the program rounded down, what it leaves of the histogram, [(configuration, times)] for that rest).

    Each phase uses the histogram up and reprices the lengths. Phases end when their sequences are within ``gap`` (and one) of the lower bound;
    the one of the fewest counts.
    """
    full, count = int(count[capacity]), np.where(np.arange(capacity + 1) == capacity, 0, count)  # a piece that fills a sequence needs no program
    base, bound, fewest, best = first_prices(capacity), 0, np.inf, None
    for _ in range(phases):
        bound = max(bound, least(count, capacity, base))
        found = fractional(count, capacity, rounds, base)
        out, left = rounded_down(count, found)
        rest = greedy(left, capacity)
        total = sum(t for _, t in out + rest)
        if total < fewest:
            fewest, best = total, (out, left, rest)
        if fewest <= bound + gap * (bound + full) + 1:
            break
        base = repriced(base, found, count)
    out, left, rest = best
    return ([(((capacity, 1),), full)] if full else []) + out, left, rest


def rounded(count: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """([(configuration, times)] of the program rounded down, what it leaves of the histogram)."""
    return program(count, capacity, rounds)[:2]


def solve(count: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[tuple, int]]:
    """[(configuration, times)] that use up the histogram: the program rounded down, and greedy ones for the rest of the rounding."""
    out, _, rest = program(count, capacity, rounds)
    return out + rest


def places(solution: list[tuple[tuple, int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (places up to and with each configuration, places in one sequence, first sequence, offset)."""
    rows: dict[int, list] = {}
    first = 0
    for config, times in solution:
        at = 0
        for v, m in config:
            rows.setdefault(v, []).append((m * times, m, first, at))
            at += v * m
        first += times
    out = {}
    for v, r in rows.items():
        a = np.array(r, np.int64)
        out[v] = (np.cumsum(a[:, 0]), a[:, 1], a[:, 2], a[:, 3])
    return out


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces; only the first piece of a longer document may be shorter."""
    n = np.maximum(1, -(-counts // capacity))
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = counts - (n - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pack(docs: DataFrame, tokenizer: str, kind: str, end: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is one id, the end. A text of any length is encoded whole and cut into pieces; all but its first have ``capacity`` ids.
    Rows stay apart, whatever their ids: repeated rows and rows with a null id have pieces of their own. Pieces of one length may
    change places, so ties do not matter to the number of sequences. Columns other than the two named are not read,
    whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    cols = ["piece", "start", "length", "ids_crc32", "part", "rank"]
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"

    def pieces(batches):
        enc, seen, part = encoder(tokenizer, kind), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                ids, counts = enc.encode(c.column("text"), end)
                doc, piece, start, length = cut(counts, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run = length[order]
                rank = np.empty(len(run), np.int64)
                rank[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)], ["doc_id", *cols])

    table = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(pieces, schema), "pieces")
    by_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    count = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        count[r["length"]] = r["n"]
    plan = broadcast_value(spark, places(solve(count, capacity), capacity))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                ix = np.flatnonzero(length == v)
                upto, m, first, at = plan.value[int(v)]
                k = np.searchsorted(upto, rank[ix], "right")
                r = rank[ix] - np.where(k > 0, upto[k - 1], 0)
                seq[ix], off[ix] = first[k] + r // m[k], at[k] + r % m[k] * v
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return table.join(before, ["part", "length"]).mapInArrow(place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
