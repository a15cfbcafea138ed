"""Segmentations, quality rules and toxicity against brute force and held-out rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluxpanel.llm import kernel as K
from fluxpanel.llm import quality, queries, segmentations, toxicity
from fluxpanel.llm.queries import tokenizer_path

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def lat():
    return segmentations.Lattices(tokenizer_path(MODEL))


def all_segmentations(lat, raw, at=0):
    if at == len(raw):
        yield (), 0.0
        return
    ends = [j for j in range(at + 1, len(raw) + 1) if j == len(raw) or raw[j] & 0xC0 != 0x80]
    for n, j in enumerate(ends):
        piece = lat.piece.get(raw[at:j])
        if piece is not None:
            for ids, w in all_segmentations(lat, raw, j):
                yield (piece, *ids), w + lat.weight[piece]
        elif n == 0:
            for ids, w in all_segmentations(lat, raw, j):
                yield (*(int(lat.byte_id[b]) for b in raw[at:j]), *ids), w + lat.unknown


def draw(lat, texts, seeds, k):
    col = K.texts(pa.array(texts, pa.string()))
    for i, n, data, at in K.slices(col, segmentations.SLICE):
        data, at = segmentations.prepared(col, i, n, data, at)
        emitted, threshold = segmentations.sample_texts(lat, data, at, np.array(seeds[i : i + n], np.uint64), k)
        for t in range(n):
            out = []
            for live, ids, counts, logp, score in emitted:
                edge = np.concatenate([[0], np.cumsum(counts)])
                if t in live:
                    out.append((tuple(ids[edge[t] : edge[t + 1]].tolist()), logp[t], score[t]))
            yield out, threshold[t]


def test_samples_follow_sequential_draws_without_replacement(lat):
    text, n = "there 漢", 12_000
    full = dict(all_segmentations(lat, (" " + text).encode()))
    total = np.logaddexp.reduce(list(full.values()))
    p = {s: float(np.exp(w - total)) for s, w in full.items()}
    pairs, weighted = Counter(), Counter()
    for samples, threshold in draw(lat, [text] * n, list(range(n)), 3):
        assert len({s for s, _, _ in samples}) == 3
        assert samples[0][2] > samples[1][2] > samples[2][2] > threshold
        for s, logp, _ in samples:
            assert abs(np.log(p[s]) - logp) < 1e-6
            weighted[s] += 1 / -np.expm1(-np.exp(logp - threshold))
        pairs[samples[0][0], samples[1][0]] += 1
    top = sorted(p, key=p.get, reverse=True)[:4]
    for a, b in itertools.permutations(top, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / n - want) < 5 * (want / n) ** 0.5 + 1e-3
    for s in top[:3]:  # inclusion scores make unbiased counts
        assert abs(weighted[s] / n - 1) < 0.15


def test_few_segmentations_are_all_given(lat):
    (samples, threshold), (empty, none), (two, _) = draw(lat, ["\n", "", "漢\n"], [1, 2, 3], 3)
    assert len(samples) <= 3 and len({s for s, _, _ in samples}) == len(samples)
    assert empty == [((), 0.0, empty[0][2])] and none == -np.inf
    count = len(dict(all_segmentations(lat, " 漢\n".encode())))
    assert len(two) == min(3, count)


def test_lattices_of_ever_new_words_take_bounded_memory(lat):
    rnd = random.Random(2)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(75_000))
    fresh, held = segmentations.Lattices(tokenizer_path(MODEL)), []
    drawn = lambda x: list(draw(x, ["common words and rare ones"] * 3, [1, 2, 3], 3))
    before = drawn(fresh)
    for _ in range(6):
        col = K.texts(pa.array([text()]))
        for i, n, data, at in K.slices(col, segmentations.SLICE):
            fresh.units(*segmentations.prepared(col, i, n, data, at))
        held.append(sum(x.nbytes for x in vars(fresh).values() if isinstance(x, np.ndarray)))
    assert max(held) < 200e6 and held[-1] < max(held) * 1.01, held
    assert drawn(fresh) == before == drawn(lat)


def test_rows_round_trip_and_repeat(spark):
    rnd = random.Random(0)
    texts = [" ".join("".join(rnd.choice("abcdeéß漢 \n\t▁'.") for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, "", " ", "word " * 4000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, sample int")
    path = tokenizer_path(MODEL)
    rows = segmentations.sample_segmentations(df, path).collect()
    assert all(r["roundtrip"] for r in rows)
    assert all(len(r["ids"]) == r["n_pieces"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    again = segmentations.sample_segmentations(df.repartition(7), path).collect()
    assert sorted((r["doc_id"], r["sample"], r["ids"]) for r in rows) == sorted((r["doc_id"], r["sample"], r["ids"]) for r in again)
    plain = spark.createDataFrame([r for r in rows if r["sample"] == 1])
    decoded = {r["doc_id"]: r["decoded"] for r in segmentations.decode_ids(plain, path).collect()}
    assert all(decoded[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    best = {r["doc_id"]: r["ids"] for r in segmentations.encode_best(df, path).collect()}
    assert len(best) == len(texts) and best[len(texts) - 3] == []
    assert segmentations.sample_segmentations(df.limit(0), path).count() == 0


def test_query_returns_the_segmentations(spark, tmp_path):
    texts = ["there 漢", "", "some words\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_segmentations(spark, str(tmp_path))
    assert {r["doc_id"] for r in rows.collect()} == {0, 1, 2, 3}
    assert all(r["decoded"] == (texts[r["doc_id"]] or "") for r in segmentations.decode_ids(rows, tokenizer_path(MODEL)).collect())


def stats_brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r\n")]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    mark = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(mark)]


def test_statistics_equal_brute_force():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["ab ", "c", " ", "\n", "é漢", "#", "x y z w v ", "same line\n", "\r", "\x0b", "A"]) for _ in range(rnd.randrange(80))) for _ in range(300)]
    texts += [None, "", "\n\n", "tail\n", "a b c d e " * 3000]
    got = quality.text_stats(pa.array(texts))
    assert got[:, :5].tolist() == [stats_brute(t) for t in texts]
    assert got[:, 5].tolist() == [len([x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r\n")]) for t in texts]


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(2000, 3)), rng.normal(size=(5, 3)) + 12])
    scores = quality.forest_scores(quality.grow_forest(x), x)
    assert set(np.argsort(-scores)[:5]) == set(range(2000, 2005))
    assert (quality.forest_scores(quality.grow_forest(x[:0]), x) == 0).all()
    same = np.ones((50, 3))
    assert np.isfinite(quality.forest_scores(quality.grow_forest(same), same)).all()


def harmonic_brute(n):
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def score_brute(forest, x):
    """The score of one row, by a walk down each tree."""
    total = 0.0
    for node in forest["roots"].tolist():
        while forest["feature"][node] >= 0:
            node = int(forest["left"][node]) + int(x[forest["feature"][node]] >= forest["cut"][node])
        total += float(forest["depth"][node])
    return 2 ** (-total / len(forest["roots"]) / float(forest["scale"]))


def depth_brute(forest, node, rows, d, limit):
    """Checks each node of a tree: leaves hold the depth and the expected rest for their rows, cuts lie within the rows' range."""
    f = int(forest["feature"][node])
    if f < 0:
        assert d == limit or len(rows) < 2 or (rows.max(0) == rows.min(0)).all()
        assert abs(float(forest["depth"][node]) - d - harmonic_brute(len(rows))) < 1e-9
        return
    c, left = float(forest["cut"][node]), int(forest["left"][node])
    assert rows[:, f].min() <= c <= rows[:, f].max()
    depth_brute(forest, left, rows[rows[:, f] < c], d + 1, limit)
    depth_brute(forest, left + 1, rows[rows[:, f] >= c], d + 1, limit)


def test_path_lengths_equal_brute_force():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(64, 5)), 1)
    forest = quality.grow_forest(x, trees=7, sample=64, chance=quality.CHANCE)
    for root in forest["roots"].tolist():
        depth_brute(forest, root, x, 0, 6)
    fresh = rng.normal(size=(200, 5)) * 2
    assert np.allclose(quality.forest_scores(forest, fresh), [score_brute(forest, r) for r in fresh])
    assert set(forest["feature"].tolist()) == {-1, 0, 1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(4))
def test_threshold_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    good, bad = rng.integers(0, 900, 80), rng.integers(500, 1500, 15)
    count = lambda x: np.bincount(x, minlength=quality.STEPS + 1)
    got = quality.best_step(count(good), count(bad))
    gain = lambda k: (bad >= k).mean() - quality.GOOD_COST * (good >= k).mean()
    assert gain(got) >= max(map(gain, range(quality.STEPS + 2))) - 1e-9
    alone = quality.best_step(count(good), count(bad[:0]), keep_good=0.9)
    assert (good >= alone).mean() <= 0.1 < (good >= alone - 1).mean()
    assert quality.best_step(count(good[:0]), count(bad)) > quality.STEPS


def test_quality_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rnd, texts = random.Random(6), []
    for i in range(500):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(5, 160))]
        if i % 10 == 0:
            w = [x + rnd.choice(["###", "$$$", " | "]) for x in w]
        if i % 17 == 0:
            w += ["\n" + " ".join(w[:6])] * 2
        texts.append(" ".join(w))
    texts += [None, "", texts[20], texts[20], " \n ", "one two three four five " * 4000]
    ids = [*range(500), None, 501, 502, 502, 503, 504]
    spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 10 > 0)) for i in range(0, 400)] + [(401, 0), (401, 1), (None, 1), (9999, 0), (402, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    grown, grow = [], quality.grow_forest
    monkeypatch.setattr(quality, "grow_forest", lambda *a, **k: grown.append(grow(*a, **k)) or grown[-1])
    rows = queries.op6_quality_rules(spark, str(tmp_path)).collect()
    by_text, base = {}, {}
    for i, t in zip(ids, texts, strict=True):
        s = [*stats_brute(t), len([x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r\n")])]
        fails = s[0] < 10 or 100 * s[4] > 20 * s[0]
        by_text.setdefault(i, []).append((s, fails, None if fails else score_brute(grown[0], quality.features(np.array([s]))[0])))
    step = lambda x: math.floor(x * quality.STEPS)
    good = [step(v[2]) for i, q in labels[:400] for v in by_text[i] if q and not v[1]]
    bad = [step(v[2]) for i, q in labels[:400] for v in by_text[i] if not q and not v[1]]
    gains = {k: np.mean([b >= k for b in bad]) - quality.GOOD_COST * np.mean([g >= k for g in good]) for k in range(quality.STEPS + 2)}
    best = [k for k, g in gains.items() if g >= max(gains.values()) - 1e-12]
    limit = best[len(best) // 2]
    want = sorted((repr(i), *s[:5], fails, not fails and step(x) < limit) for i, v in by_text.items() for s, fails, x in v)
    got = sorted((repr(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows)
    assert got == want
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) >= 35


def test_quality_sample_is_the_same_for_any_ids(spark):
    """More rows than the sample has, all of one id, of few ids, and of their own ids; one text is a third of all rows."""
    rnd = random.Random(9)
    texts = [" ".join("ab" * rnd.choice([1, 2, 3]) + "#" * (rnd.random() < 0.02) + f"{rnd.randrange(10**6)}" for _ in range(rnd.randrange(10, 40))) for _ in range(400)] + ["a b c d e f g h i j k"] * 200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").crossJoin(spark.range(100).withColumnRenamed("id", "k"))
    verdicts = []
    for key in ("bigint(0)", "doc_id % 3", "doc_id * 100 + k"):
        ids = df.select(F.expr(key).alias("doc_id"), "text", F.col("doc_id").alias("real"))
        got = quality.quality_rules(ids, None)
        assert got.count() == 60_000 > 2 * quality.TREES * quality.SAMPLE
        verdicts.append(sorted(map(tuple, got.groupBy(*quality.STATS).agg(F.max("score").alias("s")).collect())))
    assert verdicts[0] == verdicts[1] == verdicts[2] and max(v[-1] for v in verdicts[0]) > 0.4
    one = quality.sampled(quality.quality_rules(df.select(F.lit(0).cast("bigint").alias("doc_id"), "text"), None).filter("not base_failed"), 6000)
    assert 5900 < len(one) < 6100 and 1900 < (one[:, 0] == 11).sum() < 2200


def test_quality_rows(spark):
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(30, 200))) for _ in range(400)]
    texts += [" ".join(f"w{i}####$$$$" for i in range(60)), "a b", None, "one two three four five " * 40]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 2)] + [(None, 1), (10**9, 1), (3, None)], "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df, labels).collect()}
    assert len(rows) == len(texts)
    assert not rows[400]["kept"] and not rows[400]["base_failed"] and all(rows[i]["base_failed"] and not rows[i]["kept"] for i in (401, 402, 403))
    assert sum(rows[i]["kept"] for i in range(400)) >= 390
    assert quality.quality_rules(df.limit(0), labels).count() == 0
    assert quality.quality_rules(df, None).filter("not base_failed and not kept").count() == 0


def toxic_rows(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(20, 400))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Badword,", "vile", "NASTY!", "rotten"]))
        rows.append((i, " ".join(w), int(toxic), rnd.randrange(2)))
    return rows


def test_toxic_held_out_rows_are_found(spark):
    rows = toxic_rows(1500)
    df = spark.createDataFrame([(i, t, 5) for i, t, _, _ in rows], "doc_id bigint, text string, grade int")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows[:1000]], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    fresh = rows[1000:]
    assert np.mean([(not got[i]["kept"]) == bool(x) for i, _, x, _ in fresh]) > 0.98
    assert all(0 <= r["expected_severity"] <= 2 and r["toxic"] != r["kept"] for r in got.values())


def test_all_labels_outside_the_fit_set_the_cut(spark, monkeypatch):
    rows = toxic_rows(1200)
    copies = [(10_000 + i, rows[1][1] + f" extra{i}", 0, 1) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows + copies], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows + copies], "doc_id bigint, quality int, toxic int")
    seen, best = [], toxicity.best_cut
    monkeypatch.setattr(toxicity, "MANY", 50)
    monkeypatch.setattr(toxicity, "best_cut", lambda *x: seen.append(x) or best(*x))
    toxicity.train(df, labels, sample=400)
    (clean, toxic), n = seen[0], len(rows)
    assert 0.7 * n / 8 < toxic.sum() <= n / 8  # about 300 of 1,500 rows are fitted
    assert 0.6 * n * 7 / 8 < clean.sum() < 0.85 * n * 7 / 8  # and the copies weigh as one row, nearly


def test_ordinal_thresholds_ascend_and_share_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 4))
    z = x @ np.array([2.0, -1.5, 0.0, 1.0]) + rng.logistic(size=3000)
    y = np.digitize(z, [0.5, 2.0])
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, col, y, 4, l2=1e-5, steps=600)
    assert t[0] < t[1]
    assert np.abs(w - [2.0, -1.5, 0.0, 1.0]).max() < 0.3 and np.abs(t - [0.5, 2.0]).max() < 0.3


def loss_brute(x, y, weight, w, t, penalty, l2):
    """Weighted mean negative log likelihood by the cumulative links, row by row, and the penalties."""
    edge, total = [-math.inf, *t, math.inf], 0.0
    above = lambda z: 1 / (1 + math.exp(-z)) if z < 700 else 1.0
    for r, g, c in zip(x, y, weight, strict=True):
        z = sum(a * b for a, b in zip(r, w, strict=True))
        p = [1.0 if e == -math.inf else 0.0 if e == math.inf else above(z - e) for e in edge]
        total -= c * math.log(p[g] - p[g + 1])
    return total / sum(weight) + sum(q * abs(a) for q, a in zip(penalty, w, strict=True)) + l2 / 2 * sum(a * a for a in w)


def test_fit_is_the_least_of_the_penalised_likelihood():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (300, 5))
    y = np.digitize(x @ np.array([2.5, -2.0, 0.0, 0.0, 1.0]) + rng.logistic(size=300), [0.5, 2.0])
    weight, penalty = rng.uniform(0.2, 1.0, 300), np.array([0.01, 0.01, 0.08, 0.08, 0.01])
    row, col = np.nonzero(x)
    w, t = toxicity.fit_ordinal(row, col, y, 5, weight, penalty=penalty, l2=1e-3, steps=800)
    best = loss_brute(x, y, weight, w, t, penalty, 1e-3)
    assert w[0] > 0 > w[1] and w[2] == 0  # words of both signs, and those that chance explains at zero
    for i in range(5):
        for d in (-0.03, 0.03):
            near = w.copy()
            near[i] += d
            assert loss_brute(x, y, weight, near, t, penalty, 1e-3) > best - 2e-5
    for d in ([0.03, 0], [-0.03, 0], [0, 0.03], [0, -0.03]):
        assert loss_brute(x, y, weight, w, t + np.array(d), penalty, 1e-3) > best - 2e-5


def test_scores_equal_brute_force(spark):
    texts = ["Vile, vile rotten", "kind words", None, "", "kind vile", "x " * 60_000 + "vile"]
    words = toxicity.word_sets(pa.array(["kind vile rotten"]))[1]
    weight = {h: w for h, w in zip(toxicity.word_sets(pa.array(["kind"]))[1].tolist() + toxicity.word_sets(pa.array(["vile"]))[1].tolist() + toxicity.word_sets(pa.array(["rotten"]))[1].tolist(), [-1.5, 2.0, 0.5], strict=True)}
    model = {"words": words, "w": np.array([weight[h] for h in words.tolist()]), "t": np.array([0.5, 2.25]), "cut": 0.6}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, "kind vile")], "doc_id int, text string")
    rows = toxicity.score_toxicity(df, model).collect()
    assert len(rows) == 7
    link = lambda z: 1 / (1 + math.exp(-z))
    sums = [2.5, -1.5, 0.0, 0.0, 0.5, 2.0]
    for r in rows:
        a, b = link(sums[r["doc_id"]] - 0.5), link(sums[r["doc_id"]] - 2.25)
        assert abs(r["expected_severity"] - ((a - b) + 2 * b)) < 1e-12 and abs(r["p_toxic"] - a) < 1e-12
        assert r["grade"] == max(range(3), key=lambda g: [1 - a, a - b, b][g]) and r["toxic"] == (a > 0.6) != r["kept"]


def test_toxicity_query_equals_brute_force(spark, tmp_path, monkeypatch):
    """The registered query: every row's score from the weights that it fitted, word by word, and its verdict from the cut; unlabelled rows are told apart."""
    rnd = random.Random(21)
    common = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(900):
        text = [rnd.choice(common) for _ in range(rnd.randrange(5, 40))]
        if i % 6 == 0:
            text[rnd.randrange(len(text))] = rnd.choice(["vile", "Nasty,", "ROTTEN!"])
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "Élan vile-nasty 漢"), (None, "vile"), (None, "word1")]
    labels = [(i, int(i % 11 > 0), int(i % 6 == 0)) for i in range(0, 900, 2)] + [(i, 1, int(i % 6 == 0)) for i in range(3, 900, 12)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    models, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    got = queries.op5_toxicity(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    model = models[0]
    weight = dict(zip(model["words"].tolist(), model["w"].tolist(), strict=True))
    link = lambda z: 1 / (1 + math.exp(-z))
    text_of = dict(rows[:903])
    for r in got:
        if r["doc_id"] is None:
            continue
        words = {w.lower() for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text_of[r["doc_id"]] or "") if w}
        z = sum(weight.get(int(toxicity.word_sets(pa.array([w]))[1][0]), 0.0) for w in words)
        a, b = link(z - model["t"][0]), link(z - model["t"][1])
        assert abs(r["p_toxic"] - a) < 1e-9 and abs(r["expected_severity"] - (a + b)) < 1e-9 and r["kept"] == (a <= model["cut"])
    known = {i for i, _, _ in labels}
    rest = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] not in known]
    assert len(rest) > 300 and all(r["kept"] == (r["doc_id"] % 6 > 0) for r in rest)


def test_the_sample_is_bounded_in_rows_and_words(spark, monkeypatch):
    rows = [(i % 2, f"a b c{i}") for i in range(3001)] + [(2, " ".join(f"w{i}" for i in range(5000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    one = toxicity.word_rows(df, [0, 1, 2], "doc_id", "text", wide=1000).collect()
    assert sorted(r["doc_id"] for r in one) == [0, 1] and all(r["n"] == 3 for r in one)
    seen, plain = [], toxicity.minima_keys
    monkeypatch.setattr(toxicity, "minima_keys", lambda row, h, n, **k: seen.append((n, len(h))) or plain(row, h, n, **k))
    many = spark.createDataFrame([(i, f"a b c{i}") for i in range(200)], "doc_id bigint, text string")
    lots = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    toxicity.train(many, lots, sample_words=31)
    assert seen[0] == (10, 30)
    seen.clear()
    toxicity.train(df, labels, sample=2)
    assert all(n <= 2 for n, _ in seen)


def test_only_labelled_texts_are_read_for_the_fit_and_the_cut(spark, monkeypatch):
    """The ids meet the texts below the Arrow stage, and many labels, joined after it, give the same cut."""
    rows = [(i, f"w{i % 7} word {'vile' if i % 3 == 0 else 'kind'} t{i % 11}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 600, 2)], "doc_id bigint, quality int, toxic int")
    plans, made = [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or made(df, name))
    few = toxicity.train(docs, labels, sample=200)
    for name in ("word-rows", "calibration"):
        plan = dict(plans)[name]
        assert plan.index("MapInArrow") < plan.index("LeftSemi"), plan
    monkeypatch.setattr(toxicity, "FEW_IDS", 10)
    many = toxicity.train(docs, labels, sample=200)
    assert few["cut"] == many["cut"] and (few["w"] == many["w"]).all()


def test_ties_at_the_cut_stay(spark):
    model = {"words": np.zeros(0, np.uint64), "w": np.zeros(0), "t": np.array([0.0, 1.0]), "cut": 0.5}
    assert toxicity.score_toxicity(spark.createDataFrame([(1, "a")], "doc_id int, text string"), model).first()["kept"]


def test_toxicity_edge_tables(spark):
    df = spark.createDataFrame([(1, None, "c"), (None, "", "c"), (1, "x " * 40_000, "c")], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(df, labels, carry=["doc_id", "text", "kept"]).collect()
    assert len(rows) == 3 and all(r["kept"] for r in rows)
    assert all(r["kept"] for r in toxicity.toxicity(df, labels.limit(0)).collect())
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
