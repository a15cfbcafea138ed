"""Conversation structure repair by weighted finite-state composition.

A conversation's rows, in order, are an input acceptor: one symbol a row, its role initial and its fault. An edit transducer keeps, reroles or
deletes a row and inserts empty ones; a role grammar accepts ``(s?(ua)+)?``. Their composition is built lazily: a state of it is (rows read,
inserts since the last row, grammar state), and rows arrive in topological order. Weights are (cost, edit labels) in lexicographic order.

Paths that meet in a state have read the same rows and made the same number of inserts since, so that no label string of theirs begins another;
the smaller prefix then stays the smaller one whatever follows, and one best path a state is enough. Costs and ranks of the four states after
a row, less the least, take few values: a step is looked up once for each combination and row symbol, so a row costs a lookup.
Rows stream through: a conversation needs a few bytes for each of its rows, and one running hash for each grammar state instead of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role grammar: after nothing, after the system row, after a user row, after an assistant row.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: From any grammar state, what any other one accepts can be followed for two inserts and a delete more at most: paths that are further behind cannot win.
BEHIND = DELETE + 2 * INSERT
#: More inserts in a row lead back to a grammar state that fewer reach for less.
MOST_INSERTS = 2
FINE, CUT, GONE = range(3)
WHITE = " \t\n\x0b\x0c\r"


def inserts(state: int) -> list[tuple[int, str]]:
    """(grammar state, roles inserted, in capitals) after 0 to MOST_INSERTS inserts."""
    out = [(state, "")]
    for _ in range(MOST_INSERTS):
        at, roles = out[-1]
        out += [(GRAMMAR[at][r], roles + r.upper()) for r in "ua" if r in GRAMMAR[at]]
    return out


def arcs(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, str, str]]:
    """(grammar state, cost, labels, output) of all ways to read one row from a grammar state, inserts before it included.

    The output has a capital for an inserted row, a small letter for a reroled and = for a kept one.
    """
    for at, put in inserts(state):
        cost, labels = INSERT * len(put), "I" * len(put)
        yield at, cost + DELETE, labels + "D", put
        if fault == GONE:
            continue
        extra = TRUNCATED if fault == CUT else 0
        if initial in GRAMMAR[at]:
            yield GRAMMAR[at][initial], cost + extra, labels + "K", put + "="
        for r in "ua":
            if r in GRAMMAR[at]:
                yield GRAMMAR[at][r], cost + extra + REROLE, labels + "R", put + r


#: (costs less the least and ranks of label strings, by grammar state) of the paths before any row; None where there is no path.
START = ((0, 0), None, None, None)


class Machine:
    """The composed machine; its steps are made when they are first asked for."""

    def __init__(self) -> None:
        self.steps: dict = {}

    def step(self, front: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple]:
        """(paths after the row, what all of them cost more, (state before, labels, output) by grammar state)."""
        key = front, initial if initial in "sua" else "", fault
        if key not in self.steps:
            self.steps[key] = self._step(*key)
        return self.steps[key]

    @staticmethod
    def _step(front: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple]:
        best: dict = {}
        for state, path in enumerate(front):
            if path is None:
                continue
            for to, cost, labels, put in arcs(state, initial, fault):
                new = (path[0] + cost, path[1], labels, state, put)
                if to not in best or new < best[to]:
                    best[to] = new
        least = min(x[0] for x in best.values())
        best = {s: x for s, x in best.items() if x[0] - least <= BEHIND}
        order = {x: i for i, x in enumerate(sorted({(x[1], x[2]) for x in best.values()}))}
        after = tuple((best[s][0] - least, order[best[s][1:3]]) if s in best else None for s in range(4))
        return after, least, tuple((best[s][3], best[s][2], best[s][4]) if s in best else None for s in range(4))

    @staticmethod
    def finish(front: tuple) -> tuple[int, int, str]:
        """(cost, grammar state before the inserts at the end, their labels) of the best accepted path."""
        ends = [(path[0] + INSERT * len(put), path[1], "I" * len(put), state) for state, path in enumerate(front) if path for at, put in inserts(state) if at in ACCEPTING]
        cost, _, labels, state = min(ends)
        return cost, state, labels


class Run:
    """One conversation while its rows stream by."""

    def __init__(self, machine: Machine):
        self.machine, self.front, self.cost, self.back = machine, START, 0, []
        self.hashes: list = [(hashlib.sha256(), False), None, None, None]
        self.counts = [0, 0, 0]
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, fault: int, deleted: bool) -> None:
        """``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        if fault:
            self.counts[fault - 1] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        self.front, more, back = self.machine.step(self.front, initial, GONE if deleted else CUT if fault == 3 else FINE)
        self.cost += more
        self.back.append(back)
        new: list = [None] * 4
        for state, step in enumerate(back):
            if step is not None:
                before, _, put = step
                new[state] = self.added(self.hashes[before], put, role, text)
        self.hashes = new

    @staticmethod
    def added(held: tuple, put: str, role: str, text: str) -> tuple:
        digest, begun = held
        if put:
            digest = digest.copy()
            for r in put:
                line = f"{role}:{text}" if r == "=" else f"{ROLES[r]}:{text}" if r in ROLES else f"{ROLES[r.lower()]}:"
                digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                begun = True
        return digest, begun

    def done(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        cost, state, tail = self.machine.finish(self.front)
        digest, begun = self.hashes[state]
        digest, _ = self.added((digest, begun), inserts(state)[len(tail)][1], "", "")
        audit = [tail]
        for back in reversed(self.back):
            state, labels, _ = back[state]
            audit.append(labels)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts, self.illegal, self.cost + cost, "".join(reversed(audit)), digest.hexdigest()


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, the first of 1 blank, 2 duplicate and 3 truncated, to conv_id, turn, role, text and absent; absent rows have none."""
    bare = F.rtrim("text", F.lit(WHITE))
    seen = Window.partitionBy("conv_id", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(bare == "", 1).when(F.row_number().over(seen) > 1, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.withColumn("fault", F.when(F.col("absent"), 0).otherwise(fault))


def repaired(batches):
    """Rows sorted by conversation and order to one row a conversation."""
    machine, key, run, out = Machine(), None, None, []
    kind = None

    def batch():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())], NAMES)

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, turn, role, text, fault, absent in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "absent")], strict=True):
            if run is None or conv != key:
                if run is not None:
                    out.append((key, *run.done()))
                key, run = conv, Run(machine)
            if not absent:
                run.row(turn, role, text, fault, fault in (1, 2))
        if len(out) > 4096:
            yield batch()
            out = []
    if run is not None:
        out.append((key, *run.done()))
    if out:
        yield batch()


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_conversations(rows: DataFrame, absent: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` has conv_id, turn, role and text; a null role or text is one space. Rows of a conversation are taken by turn, null turns first, then by
    role and text. Rows where ``absent`` holds have no part, but their conversation has its row: with no other rows, zeros, an empty audit and
    the hash of nothing. A row that repeats role and text of an earlier one is a duplicate and must go, repeated rows of the table too. A null conv_id is a
    conversation of its own. Ties of cost are broken by the edits' initials. Texts are read whole, however long; other columns, whatever their names, are not
    read. An empty table gives no rows. A conversation's edits and hash depend on all rows before, so its rows go through one task, one at a time.
    """
    kinds = dict(rows.dtypes)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    gone = F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False)
    narrow = rows.select("conv_id", "turn", space("role"), F.when(~gone, F.coalesce(F.col("text"), F.lit(" "))).otherwise("").alias("text"), gone.alias("absent"))
    dealt = faults(narrow.repartition("conv_id"))
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)
    schema = f"conv_id {kinds['conv_id']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return ordered.mapInArrow(repaired, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by a checksum of conversation and turn: rows marked absent, emptied, robbed of ``.!?``, repeated, or with role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    out = out.withColumn("kind", (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).cast("int"))
    out = out.withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"),
    )
