"""Conversation repair against a search over all edits, and against SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import conversations as C
from fluxpanel.llm import queries


def search(rows):
    """(cost, audit, lines) by uniform-cost search over (cost, audit): the first accepted path is the cheapest, ASCII-least one."""
    seen = [(r, t) for r, t in rows]
    gone = [not re.search(r"[^\x20\x09-\x0D]", t) or (r, t) in seen[:i] for i, (r, t) in enumerate(seen)]
    cut = [not g and re.sub(r"[\x20\x09-\x0D]+\Z", "", t)[-1] not in ".!?" for (_, t), g in zip(seen, gone, strict=True)]
    todo = [(0, "", 0, "", ())]
    while todo:
        cost, audit, i, made, lines = heapq.heappop(todo)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, lines
        if cost > 4 * len(rows):
            continue
        nexts = [(3, "I", 0, r[0], f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            nexts.append((4, "D", 1, "", None))
            if not gone[i]:
                nexts.append((3 * cut[i], "K", 1, role[:1] or "?", f"{role}:{text}"))
                nexts += [(3 + 3 * cut[i], "R", 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for c, label, step, out, line in nexts:
            if re.fullmatch("(s?(ua)*u?)?", made + out):
                heapq.heappush(todo, (cost + c, audit + label, i + step, made + out, lines if line is None else (*lines, line)))
    raise AssertionError("no path")


def run(rows, turns=None):
    turns = turns or list(range(len(rows)))
    r = C.Run(C.Machine())
    for i, (role, text) in enumerate(rows):
        bare = text.rstrip(C.WHITE)
        fault = 1 if not bare else 2 if (role, text) in rows[:i] else 3 if bare[-1] not in ".!?" else 0
        r.row(turns[i], role, text, fault, fault in (1, 2))
    return r.done()


@pytest.mark.parametrize("seed", range(4))
def test_paths_equal_a_search_over_all_edits(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        rows = [(rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", " ", "", "udder"]), rnd.choice(["", " \n", "a.", "b!", "c?", "d", "e . \t", f"x{rnd.random()}."])) for _ in range(rnd.randrange(0, 7))]
        got = run(rows)
        cost, audit, lines = search(rows)
        assert (got[5], got[6], got[7]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_counts():
    rows = [("system", "s."), ("user", "u"), ("user", "u"), ("assistant", ""), ("user", "v?")]
    assert run(rows, [None, 2, 2, 5, 9])[:5] == (8 - 3, 1, 1, 1, 1)
    assert run([], [])[:7] == (0, 0, 0, 0, 0, 0, "") and run([])[7] == hashlib.sha256(b"").hexdigest()
    assert run([("user", "a."), ("user", "b.")], [None, None])[0] == 0


def test_a_long_conversation_streams():
    rows = [(("user", "assistant")[i % 2 ^ (i % 97 == 0)], f"text {i}" + "." * (i % 13 > 0)) for i in range(50_000)]
    r = C.Run(C.Machine())
    for i, (role, text) in enumerate(rows):
        r.row(i, role, text, 0 if text[-1] == "." else 3, False)
    out = r.done()
    assert len(out[6]) >= 50_000 and len(r.machine.steps) < 500


def brute(rows):
    """The registered query's rows, from the contract's words."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        out.append((conv, *run([x[1:] for x in held], [x[0] for x in held])))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rnd = random.Random(8)
    texts = ["Hm.", "Yes!", "no", "", None, " ", "\n", "e é。", "Why? ", "a.b", "long " * 5000 + "."]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, *range(-2, 9)]), rnd.choice(["user", "assistant", "system", None, "tool", ""]), rnd.choice(texts)) for _ in range(400)]
    rows += rows[:20] + [(1000, 5, "user", "x.")] + [(c, 0, "user", "gone.") for c in range(2000, 2100)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, absent string, fault string").repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op12_conversation_repair(spark, str(tmp_path))
    got = order(map(tuple, out.collect()))
    assert got == order(brute(rows))
    assert any(r[1:8] == (0, 0, 0, 0, 0, 0, "") for r in got)  # one whose rows are all dropped
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_conversation_repair"])
    assert [d[0] for d in want.description] == out.columns
    assert order(want.fetchall()) == got


def test_general_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yes"), (2, 0, None, None)], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in C.repair_conversations(df).collect()}
    assert got == {1: (3, "KK"), 2: (4, "D")}
    assert C.repair_conversations(df.limit(0)).count() == 0
    assert C.repair_conversations(df, F.col("conv_id") == 2).filter("conv_id = 2").first()["audit"] == ""
