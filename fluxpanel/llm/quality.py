"""Quality rules: statistics of each whole text, base limits, then an isolation forest with a calibrated threshold.

The statistics are made in one pass and written; the forest is grown on the driver from about ``TREES`` x ``SAMPLE`` rows of those that
pass the base limits (a bounded sample, as the method has it: each tree sees ``SAMPLE`` rows). Rows of equal statistics are counted, and
each such group sends its share of the sample, rounded up or down by a hash of the statistics: ids play no part in it. Every row is then scored once. The threshold comes from the scores of all labelled rows, good and bad ones,
that pass the base limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import broadcast_value, written

TREES, SAMPLE = 100, 256
#: Relative chance of each of ``features`` to be split on. Most texts repeat nothing, so that splits on repeats alone would isolate good texts.
CHANCE = (1.0, 1.0, 0.25, 0.25, 0.25)
#: Share of repeated lines or words that counts as none.
USUAL = 0.1
#: Scores are counted by this many steps; a share of good rows rejected costs as much as so many times that share of bad rows kept.
STEPS, GOOD_COST = 2000, 5.0
#: Share of the labelled good rows that the threshold keeps where no bad ones are labelled.
KEEP_GOOD = 0.995
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def text_stats(col: pa.Array) -> np.ndarray:
    """STATS of each text, as columns of a matrix of int64."""
    col = K.texts(col)
    out = np.zeros((len(col), len(STATS)), np.int64)
    for i, n, data, at in K.slices(col):
        rows = out[i : i + n]
        if not len(data):
            continue
        s, e, woff = K.split(data, at)
        rows[:, 0] = np.diff(woff)
        run = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        rows[:, 1] = run(~K.SPACE[data] & ((data & 0xC0) != 0x80))
        rows[:, 2] = run(SYMBOLS[data])
        doc = np.repeat(np.arange(n), np.diff(woff))
        salt = K.numbers(n, 11)
        # lines: cut at each newline and at each text's edges
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        nl = np.flatnonzero(data == 10)
        cut[nl + 1] = True
        ls = np.flatnonzero(cut)
        ls = ls[ls < len(data)]
        le = np.append(ls[1:], len(data))
        le = le - (data[le - 1] == 10)
        words_before = np.searchsorted(s, ls), np.searchsorted(s, np.maximum(le, ls))
        full = words_before[1] > words_before[0]
        ls, le = ls[full], le[full]
        ldoc = np.searchsorted(at, ls, "right") - 1
        _, first = np.unique(K.span_hashes(data, ls, le) ^ salt[ldoc], return_index=True)
        rows[:, 5] = np.bincount(ldoc, minlength=n)
        rows[:, 3] = rows[:, 5] - np.bincount(ldoc[first], minlength=n)
        first, w = K.windows(K.span_hashes(data, s, e), woff, 5, 5)
        if len(first):
            _, inv, count = np.unique(w ^ salt[doc[first]], return_inverse=True, return_counts=True)
            mark = K.covered(first[count[inv] > 1], 5, len(s))
            rows[:, 4] = np.bincount(doc[mark], minlength=n)
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """Numbers that the forest splits on, from all statistics: symbols a word; the logarithm of the mean word length, drawn towards five letters
    in short texts; the shares of repeated lines and of repeated words above ``USUAL``; the logarithm of the number of words."""
    n, chars, symbols, dup, repeat, lines = stats.astype(float).T
    over = lambda x, of: np.maximum(x / np.maximum(of, 1) - USUAL, 0.0)
    return np.column_stack([symbols / np.maximum(n, 1), np.log((chars + 5 * 20) / (n + 20)), over(dup, lines), over(repeat, n), np.log1p(n)])


def _harmonic(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 0, chance: tuple = ()) -> dict[str, np.ndarray]:
    """Random splits in flat arrays: feature (-1: leaf), cut, left child (the right one follows it), path length."""
    rng, chance = np.random.default_rng(seed), np.array(chance or np.ones(x.shape[1]))
    feature, cut, left, depth, roots = [], [], [], [], []
    sample = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(sample, 2))))
    for _ in range(trees if len(x) else 0):
        roots.append(len(feature))
        todo = [(len(feature), x[rng.choice(len(x), sample, replace=False)], 0)]
        feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
        while todo:
            node, rows, d = todo.pop()
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if d >= limit or len(rows) < 2 or not len(open_):
                depth[node] = d + float(_harmonic(len(rows)))
                continue
            f = int(rng.choice(open_, p=chance[open_] / chance[open_].sum()))
            c = float(rng.uniform(low[f], high[f]))
            feature[node], cut[node], left[node] = f, c, len(feature)
            for side in (rows[:, f] < c, rows[:, f] >= c):
                todo.append((len(feature), rows[side], d + 1))
                feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
        # a side may be empty by rounding; it is then a leaf of no rows
    return {"feature": np.array(feature, np.int32), "cut": np.array(cut), "left": np.array(left, np.int32), "depth": np.array(depth), "roots": np.array(roots, np.int32), "scale": np.array(float(_harmonic(sample)) or 1.0)}


def forest_scores(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Anomaly scores in (0, 1]; a forest of no trees gives 0."""
    total = np.zeros(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root)
        live = np.flatnonzero(forest["feature"][at] >= 0)
        while len(live):
            node = at[live]
            at[live] = forest["left"][node] + (x[live, forest["feature"][node]] >= forest["cut"][node])
            live = live[forest["feature"][at[live]] >= 0]
        total += forest["depth"][at]
    return np.exp2(-total / max(len(forest["roots"]), 1) / forest["scale"]) if len(forest["roots"]) else total


def best_step(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> int:
    """Score step (of STEPS) from which rows are rejected, given the labelled rows by step of their score.

    The greatest share of bad rows rejected less GOOD_COST times the share of good rows rejected; the middle one of equal ones.
    Without bad rows, the lowest step that keeps ``keep_good`` of the good ones; without good rows, none.
    """
    if not good.sum():
        return STEPS + 1
    lost = np.append(np.cumsum(good[::-1])[::-1], 0) / good.sum()
    if not bad.sum():
        return int(np.flatnonzero(lost <= 1 - keep_good + 1e-12)[0])
    gain = np.append(np.cumsum(bad[::-1])[::-1], 0) / bad.sum() - GOOD_COST * lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return int(best[len(best) // 2])


def sampled(table: DataFrame, size: int) -> np.ndarray:
    """STATS of about ``size`` rows, in ascending order: of c equal rows among n, c * size / n, rounded by chance; all rows where there are no more than ``size``."""
    groups = written(table.groupBy(*STATS).agg(F.count(F.lit(1)).alias("c")), "vectors")
    total = groups.agg(F.sum("c")).first()[0] or 0
    chance = F.pmod(F.xxhash64(F.lit(17), *STATS), F.lit(1 << 40)) / F.lit(float(1 << 40))
    take = F.floor(F.col("c") * F.lit(size / total) + chance) if total > size else F.col("c")
    got = groups.select(*STATS, take.alias("k")).filter("k > 0").toPandas().astype(np.int64)  # about ``size`` rows at most
    got = got.sort_values(STATS)
    return np.repeat(got[STATS].to_numpy().reshape(-1, len(STATS)), got["k"].to_numpy(), axis=0)


def _stats_batches(batches):
    for b in batches:
        stats = text_stats(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(stats[:, i]) for i in range(len(STATS))]], ["doc_id", *STATS])


def quality_rules(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, STATS, base_failed, score and kept of every row.

    ``labels`` has doc_id and quality (1: good, 0: bad); null labels, labels of no row and ids with labels of both kinds are not used.
    Without labelled good rows the forest rejects nothing. A null text has no words and fails the base limits. A row whose
    score ties with the threshold's step is rejected like those above. Rows with a null id are judged like others. Repeated rows give repeated rows
    with one verdict, whatever their number and their ids. Texts are read whole, however long. Columns other than the two named are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {kinds[id_col]}, " + ", ".join(f"{c} bigint" for c in STATS)
    table = written(narrow.mapInArrow(_stats_batches, schema), "quality")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    forest = broadcast_value(spark, grow_forest(features(sampled(table.filter(~failed), trees * sample)), trees, sample, chance=CHANCE))

    def score(batches):
        for b in batches:
            stats = np.column_stack([b.column(c).to_numpy() for c in STATS]) if b.num_rows else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest_scores(forest.value, features(stats)))], [*b.schema.names, "score"])

    scored = written(table.mapInArrow(score, schema + ", score double"), "scored")
    step = F.floor(F.col("score") * F.lit(STEPS)).cast("int")
    limit = STEPS + 1
    if labels is not None:
        known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_l")).agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = most")
        counts = np.zeros((2, STEPS + 1))
        for r in scored.filter(~failed).join(known, F.col("doc_id") == F.col("_l")).groupBy(step.alias("step"), "least").count().collect():  # two for each step at most
            counts[int(r["least"]), r["step"]] = r["count"]
        limit = best_step(counts[1], counts[0])
    return scored.select("doc_id", *STATS, failed.alias("base_failed"), "score", (~failed & (step < F.lit(limit))).alias("kept"))
