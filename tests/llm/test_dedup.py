"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import substring_dedup as passages
from fluxpanel.llm.exact_dedup import exact_dedup, judged, marked
from fluxpanel.llm.minhash import by_cheaper_groups, near_dedup
from fluxpanel.llm.substring_dedup import AnchorBucket, WindowBucket, substring_dedup

DOCS = "doc_id bigint, text string, lang string, keep_id string, group_size int"
SPACE = re.compile("[\x20\x09-\x0d]+")


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "clash", 7) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_exact_groups(spark):
    texts = ["a b", "a\t\n b", None, "", " ", "a b", "A b", "a b", "x" * 50_000, "x" * 50_000, "a b "]
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, texts)).collect()}
    norm = [SPACE.sub(" ", t or "") for t in texts]
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])
        assert got[i]["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()


@pytest.mark.parametrize("bits", [1 << 15, 64])
def test_exact_saturated_filter_and_hot_group(spark, bits):
    texts = ["hot"] * 300 + [f"text {i // 2}" for i in range(300)]
    table = spark.createDataFrame([(i, i, t, i) for i, t in enumerate(texts)], "c0 bigint, id bigint, digest string, row bigint")
    rows = judged(table, bits, 2).collect()
    assert len(rows) == 600 and sum(r["kept"] for r in rows) == 151
    assert {r["group_size"] for r in rows if r["keep_id"] == 0} == {300}


def test_exact_ranges_of_digests(spark):
    texts = ["hot"] * 300 + [f"text {i // 2}" for i in range(300)]
    rows = exact_dedup(frame(spark, texts), max_bits=1 << 13).collect()  # four ranges, a filter each
    assert len(rows) == 600 and sum(r["kept"] for r in rows) == 151
    assert {r["group_size"] for r in rows if r["keep_id"] == 0} == {300}
    assert exact_dedup(frame(spark, ["a", "a", None]), max_bits=1 << 13).count() == 3  # with ranges that have no rows


def test_unique_rows_pass_straight_through(spark):
    n, ranges = 8000, 8
    table = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    part = table.filter(F.pmod(F.xxhash64(F.lit(-1), "digest"), F.lit(ranges)) == 0)
    assert n / ranges * 0.8 < part.count() < n / ranges * 1.2
    assert marked(part, 1 << 14, 2).filter("maybe").count() <= 0.03 * n / ranges  # 16 bits a row of the range
    assert marked(table, 1 << 10, 2).filter("maybe").count() > 0.9 * n  # one small filter for all would let none pass


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    df = frame(spark, ["a", "a", "a", "b"], [5, 5, None, None])
    rows = exact_dedup(df, carry=["doc_id", "lang"]).collect()
    assert sum(r["kept"] for r in rows) == 2 and len(rows) == 4
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {5}
    assert exact_dedup(df.limit(0)).count() == 0


def near_brute(texts, size, percent):
    sets = []
    for t in texts:
        w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [len(s) for s in sets], comp


def near_texts(seed, groups=6, members=9, length=60):
    rnd = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rnd.randrange(4000)}" for _ in range(length)]
        for _ in range(members):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                t[rnd.randrange(len(t))] = f"z{rnd.randrange(10**6)}"
            out.append(" ".join(t))
    out += ["", None, " \n ", "one", "One", "one two", "ONE two", "one two three"]
    rnd.shuffle(out)
    return out


def test_near_candidates_are_compared_by_pivot_where_that_is_less(spark):
    chain = [(i, i - 1) for i in range(1, 10)]  # ten texts in a row, each tied to the one before it
    hub = [(i, 20) for i in range(21, 25)]  # four texts tied to one
    same = [(i, i - 1) for i in range(31, 40)]  # a chain that is one component already
    ties = spark.createDataFrame([*chain, *hub, *same], "id bigint, pivot bigint")
    where = [*[(i, 0, i) for i in range(10)], *[(i, 20, i) for i in range(20, 25)], *[(i, 30, 30) for i in range(30, 40)]]
    got = sorted(map(tuple, by_cheaper_groups(ties, spark.createDataFrame(where, "id bigint, cluster bigint, component bigint"), 2).collect()))
    assert got == sorted([*[(i, p, i) for p in range(9) for i in (p, p + 1)], *where[10:]])


@pytest.mark.parametrize("seed,size,percent,block", [(0, 3, 85, 768), (1, 5, 80, 768), (2, 3, 85, 4), (3, 3, 85, 2)])
def test_near_components_equal_brute_force(spark, seed, size, percent, block):
    texts = near_texts(seed)
    n, comp = near_brute(texts, size, percent)
    rows = {r["doc_id"]: r for r in near_dedup(frame(spark, texts), size=size, percent=percent, block=block).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == n
    assert [rows[i]["component_id"] for i in range(len(texts))] == comp
    assert all(rows[i]["kept"] == (rows[i]["component_id"] == i) for i in rows)


def test_near_edge_tables(spark):
    df = frame(spark, ["a b c d e f"] * 3, [3, None, 3])
    rows = near_dedup(df).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in rows) == [(-1, True), (3, True), (3, True)]
    assert near_dedup(df.limit(0)).count() == 0


def alike(seed, changed, length=200):
    """Two texts of one length, ``changed`` words of the second replaced in one stretch."""
    rnd = random.Random(seed)
    a = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
    return " ".join(a), " ".join([*(f"z{rnd.randrange(10**6)}" for _ in range(changed)), *a[changed:]])


@pytest.mark.parametrize("changed,linked", [(8, True), (50, False)])
@pytest.mark.parametrize("blank", ["", None, " \n"])
def test_near_ids_shared_with_texts_without_words(spark, changed, linked, blank):
    a, b = alike(1, changed)
    rows = near_dedup(frame(spark, [a, blank, b, alike(2, 0)[0], blank], [1, 1, 2, 3, 2]), size=3, percent=85).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    two = 1 if linked else 2
    assert got == sorted([(1, 198, 1), (1, 0, 1), (2, 198, two), (2, 0, 2), (3, 198, 3)])


def test_near_ids_shared_by_unlike_texts(spark):
    (a, b), (c, d) = alike(3, 8), alike(4, 50)
    rows = near_dedup(frame(spark, [a, c, b, d], [1, 1, 2, 5]), size=3, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (1, 1), (2, 1), (5, 5)]


@pytest.mark.parametrize("shingles", [150, 700])
def test_near_blocks_of_long_texts_are_bounded_by_shingles(spark, shingles):
    texts = near_texts(5)
    _, comp = near_brute(texts, 3, 85)
    rows = {r["doc_id"]: r["component_id"] for r in near_dedup(frame(spark, texts), size=3, percent=85, shingles=shingles).collect()}
    assert [rows[i] for i in range(len(texts))] == comp


def substring_brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    passages = [[f"p{rnd.randrange(50)}" for _ in range(rnd.randrange(15, 45))] for _ in range(6)]
    texts = []
    for _ in range(80):
        t = []
        for _ in range(rnd.randrange(4)):
            t += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(12))] + rnd.choice(passages)
        texts.append(rnd.choice([" ", "\n", " \t"]).join(t))
    texts += [None, "", "same " * 70, "same " * 25, "x" * 30_000]
    want = substring_brute(enumerate(texts), 20)
    rows = {r["doc_id"]: r for r in substring_dedup(frame(spark, texts), with_text=True).collect()}
    for i, (n, gone, digest) in want.items():
        assert (rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (n, gone, digest)
        if not gone:
            assert rows[i]["kept_text"] == texts[i]
        assert hashlib.sha256(" ".join(words(rows[i]["kept_text"])).encode()).hexdigest() == digest


def test_substring_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = frame(spark, [text, text, text], [4, 4, None])
    rows = substring_dedup(df, carry=["doc_id", "keep_id"]).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 25, 25]
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [25]
    assert substring_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunks", [1, 5])
def test_substring_passage_in_every_chunk_by_small_parts(spark, monkeypatch, chunks):
    monkeypatch.setattr(passages, "CHUNK_BYTES", 150)
    monkeypatch.setattr(passages, "TASK_CHUNKS", chunks)
    monkeypatch.setattr(passages, "PART_BYTES", 200)
    rnd = random.Random(5)
    hot = [f"h{i}" for i in range(35)]
    texts = []
    for _ in range(60):
        t = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
        at = rnd.randrange(len(t) + 1)
        texts.append(" ".join([*t[:at], *hot, *t[at:]]))
    texts[7] = " ".join(hot * 3)
    want = substring_brute(enumerate(texts), 20)
    rows = {r["doc_id"]: r for r in substring_dedup(frame(spark, texts)).collect()}
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in rows.items()} == want


def test_substring_buckets_keep_distinct_keys_only():
    rnd = random.Random(8)
    sent = [(g, k, rnd.random() < 0.05) for g in range(400) for k in sorted({0, *(rnd.randrange(1, 3000) for _ in range(5))})]
    rnd.shuffle(sent)
    holders, sure = {}, set()
    for g, k, several in sent:
        holders.setdefault(k, []).append(g)
        if several:
            sure.add(k)
    bucket, told = AnchorBucket(), []
    for i in range(0, len(sent), 37):
        g, k, several = zip(*sent[i : i + 37], strict=True)
        who, key = bucket.take(np.array(k, np.uint64), np.array(g), np.array(several))
        told += zip(who.tolist(), key.tolist(), strict=True)
    assert len(bucket.key) == len(holders)
    assert sorted(told) == sorted((g, k) for k, all_of in holders.items() for g in all_of if len(all_of) > 1 or k in sure)

    windows = [(rnd.randrange(40), rnd.randrange(2), rnd.randrange(9), chunk, n) for chunk in range(300) for n in range(3)]
    rnd.shuffle(windows)
    bucket, lost = WindowBucket(), []
    for i in range(0, len(windows), 41):
        k1, k2, own, chunk, n = (np.array(a) for a in zip(*windows[i : i + 41], strict=True))
        who, index = bucket.take(k1.astype(np.uint64), k2.astype(np.uint32), own, chunk, n)
        lost += zip(who.tolist(), index.tolist(), strict=True)
    first = {}
    for k1, k2, own, chunk, n in windows:
        first[k1, k2] = min(first.get((k1, k2), (own, chunk)), (own, chunk))
    assert len(bucket.k1) == len(first) and len(lost) == len(set(lost)) == len(windows) - len(first)
    left = {(k1, k2): (own, chunk) for k1, k2, own, chunk, n in windows if (chunk, n) not in set(lost)}
    assert left == first
