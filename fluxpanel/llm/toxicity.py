"""Toxicity by cumulative-link ordinal regression on the set of words of each text.

P(grade > j) = logistic(w . x - t_j): one weight vector for all thresholds t_0 <= t_1 <= ... Features are the distinct
bare words of a text (ASCII letters lower-cased), by 64-bit hash, of the words that occur in at least ``MIN_DOCS`` of the texts of
the training sample. Words speak for or against toxicity; an absolute penalty, in proportion to each word's spread and to what
chance alone gives the best of so many words, leaves most of them at zero. Texts that share a key of hash minima of their words,
as copies do, share one row's weight. Grades from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The labels have no degrees
of toxicity: grade 2 says that a toxic text is bad in another way too, and the expected severity is a mean over these grades.
The fit takes three quarters of at most ``SAMPLE`` labelled ids (picked by a hash of the id), one row each, ``SAMPLE_WORDS`` words in
all and ``WIDE`` a text at most, on the driver. All other labelled rows set the rejection threshold: one pass scores them, and only
counts by cut reach the driver. Every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded_sample, broadcast_value, written

#: Bounds of the sample that is fitted: labelled ids, distinct words of all texts, distinct words of one text.
SAMPLE, SAMPLE_WORDS, WIDE = 12_000, 4_000_000, 40_000
MIN_DOCS = 5
#: Absolute penalty, as a share of the largest slope that chance alone is likely to give one of the words.
PENALTY = 0.6
GRADES = 3
#: Rows with a common key of hash minima from which the key's count is joined by itself.
MANY = 1000
#: Labelled ids up to which their texts are picked by a broadcast of the ids before anything reads them; beyond, all texts are read and the results joined.
FEW_IDS = 500_000


def word_sets(col: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct bare words of each text, ordered by row; with ``only``, (row, place in it)."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, K.U64 if only is None else np.int64)]
    for i, n, data, at in K.slices(K.texts(col)):
        s, e, woff = K.split(data, at, K.NOT_ALNUM)
        h = K.span_hashes(data, s, e, lower=True)
        doc = np.repeat(np.arange(n), np.diff(woff))
        if only is not None:
            place = np.minimum(np.searchsorted(only, h), max(len(only) - 1, 0))
            hit = only[place] == h if len(only) else np.zeros(len(h), bool)
            both = np.unique(doc[hit] * max(len(only), 1) + place[hit])
            rows.append(both // max(len(only), 1) + i)
            found.append(both % max(len(only), 1))
        else:
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            rows.append(doc[first] + i)
            found.append(h[first])
    return np.concatenate(rows), np.concatenate(found)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


#: Probabilities that the rejection threshold is chosen from.
GRID = logistic(np.linspace(-6, 4, 101))


def fit_ordinal(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray | None = None, grades: int = GRADES, penalty: np.ndarray | float = 0.0, l2: float = 1e-5, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise the mean negative log likelihood + sum(penalty |w|) + l2 / 2 sum(w^2).

    Adam on the full batch with a falling rate, each step followed by the penalty's own in the same metric; thresholds are kept
    ascending by positive steps.
    """
    weight = np.ones(len(y)) if weight is None else weight
    n = max(weight.sum(), 1e-9)
    # share of rows above each grade gives the first thresholds
    share = np.clip([((y > j) * weight).sum() / n for j in range(grades - 1)], 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(width), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v, at = np.zeros_like(theta), np.zeros_like(theta), np.arange(len(y))
    for k in range(1, steps + 1):
        w, raw = theta[:width], theta[width:]
        t = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        z = np.bincount(row, w[col], minlength=len(y)) if len(row) else np.zeros(len(y))
        above = np.column_stack([np.ones(len(y)), logistic(z[:, None] - t), np.zeros(len(y))])
        p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
        slope = above * (1 - above)
        gz = -weight * (slope[at, y] - slope[at, y + 1]) / p
        gt = np.array([(weight * ((y == j + 1) * slope[:, j + 1] / p - (y == j) * slope[:, j + 1] / p)).sum() for j in range(grades - 1)])
        gw = np.bincount(col, gz[row], minlength=width) / n + l2 * w if len(row) else l2 * w
        graw = np.array([gt.sum(), *[gt[j:].sum() * np.exp(raw[j]) for j in range(1, grades - 1)]]) / n
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1.02 - k / steps) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        theta = theta - step * m / (1 - 0.9**k)
        theta[:width] = np.sign(theta[:width]) * np.maximum(np.abs(theta[:width]) - step[:width] * penalty, 0.0)
    w, raw = theta[:width], theta[width:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def penalties(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, weight: np.ndarray, strength: float = PENALTY) -> np.ndarray:
    """By word: ``strength`` times the size that the likelihood's slope at zero has by chance for the best of ``width`` words with that word's spread."""
    n = max(weight.sum(), 1e-9)
    share = np.bincount(col, weight[row], minlength=width) / n
    toxic = (weight * (y > 0)).sum() / n
    return strength * np.sqrt(share * np.maximum(1 - share, 0.0) * toxic * (1 - toxic) * 2 * np.log(max(width, 2)) / n)


def minima_keys(row: np.ndarray, h: np.ndarray, n: int, bands: int = 6, rows: int = 3) -> np.ndarray:
    """``bands`` keys of ``rows`` hash minima each of n word sets, given as (row, hash) ordered by row; minima of an empty set are 0."""
    least = np.zeros((n, bands * rows), K.U64)
    full, at = np.unique(row, return_index=True)
    for j, m in enumerate(K.numbers(bands * rows, 61) | K.U64(1)):
        if len(full):
            least[full, j] = np.minimum.reduceat(h * m, at)
    least = least.reshape(n, bands, rows)
    key = K.mix(K.mix(least[:, :, 0]) + least[:, :, 1])
    for r in range(2, rows):
        key = K.mix(key + least[:, :, r])
    return key


def copy_weights(keys: np.ndarray) -> np.ndarray:
    """1 / the most rows that share a key with a row."""
    most = np.ones(len(keys), np.int64)
    for key in keys.T:
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        most = np.maximum(most, count[group])
    return 1.0 / most


def best_cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """Probability above which a text is rejected: the middle of the cuts with the best F1; 0.5 if the rows cannot tell.

    Both arrays have the weight of the rows by the number of cuts of GRID that they are above.
    """
    if not clean.sum() or not toxic.sum():
        return 0.5
    above = lambda x: x.sum() - np.cumsum(x)[:-1]
    tp = above(toxic)
    f1 = 2 * tp / (tp + above(clean) + toxic.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(GRID[best[len(best) // 2]])


def calibration(docs: DataFrame, labelled: DataFrame, model: dict, fitted: list, id_col: str, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the clean and of the toxic labelled rows (of ``n`` ids) that took no part in the fit, by the number of cuts that they are above."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    shared = broadcast_value(spark, ({k: model[k] for k in ("words", "w", "t")}, frozenset(fitted)))

    def levels(batches):
        m, seen = shared.value
        for b in batches:
            b = b.filter(pa.array([x is not None and x not in seen for x in b.column("doc_id").to_pylist()], pa.bool_()))
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                row, h = word_sets(c.column("text"))
                place = np.minimum(np.searchsorted(m["words"], h), max(len(m["words"]) - 1, 0))
                hit = m["words"][place] == h if len(m["words"]) else np.zeros(len(h), bool)
                z = np.bincount(row[hit], m["w"][place[hit]], minlength=c.num_rows) if hit.any() else np.zeros(c.num_rows)
                level = np.searchsorted(GRID, logistic(z - m["t"][0])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(level), pa.array(minima_keys(row, h, c.num_rows).view(np.int64).tolist(), pa.list_(pa.int64()))], ["doc_id", "level", "keys"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if n <= FEW_IDS:
        rows = rows.join(F.broadcast(labelled.select(F.col("_l").alias("doc_id"))), "doc_id", "left_semi")
    rows = rows.mapInArrow(levels, f"doc_id {kind}, level int, keys array<bigint>")
    rows = rows.join(labelled.select(F.col("_l").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")), "doc_id")
    # equal rows are one row with their number, so that a group of copies stays small
    rows = written(rows.groupBy("level", "toxic", "keys").agg(F.count(F.lit(1)).alias("n")), "calibration")
    each = rows.select("*", F.posexplode("keys").alias("band", "key"))
    shared_by = written(each.groupBy("band", "key").agg(F.sum("n").alias("most")).filter("most > 1"), "calibration-keys")
    few, many = shared_by.filter(F.col("most") < MANY), shared_by.filter(F.col("most") >= MANY)  # broadcast where Spark finds them small enough; else AQE splits the hot ones
    hot = each.join(many, ["band", "key"])
    cold = each.join(many, ["band", "key"], "left_anti").join(few, ["band", "key"], "left").withColumn("most", F.coalesce("most", F.lit(1)))
    cols = ["level", "toxic", "keys", "n"]
    most = hot.select(*cols, "most").unionByName(cold.select(*cols, "most")).groupBy(*cols).agg(F.max("most").alias("most"))
    out = np.zeros((2, len(GRID) + 1))
    for r in most.groupBy("level", "toxic").agg(F.sum(F.col("n") / F.col("most")).alias("weight")).collect():  # two for each cut at most
        out[int(r["toxic"]), r["level"]] = r["weight"]
    return out[0], out[1]


def word_rows(docs: DataFrame, ids: list, id_col: str, text_col: str, wide: int = WIDE) -> DataFrame:
    """doc_id, n, words (hashes, ascending) of the texts with the given ids and ``wide`` distinct words at most: one row an id, the least words of those that share it."""
    kind = dict(docs.dtypes)[id_col]
    wanted = docs.sparkSession.createDataFrame([(x,) for x in ids], f"doc_id {kind}")  # SAMPLE rows at most

    def sets(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                row, h = word_sets(c.column("text"))
                at = np.searchsorted(row, np.arange(c.num_rows + 1))
                count = np.diff(at)
                raw, ok = h.tobytes(), np.flatnonzero(count <= wide)
                yield pa.RecordBatch.from_arrays([c.column("doc_id").take(pa.array(ok)), pa.array(count[ok]), pa.array([raw[8 * at[j] : 8 * at[j + 1]] for j in ok.tolist()], pa.binary())], ["doc_id", "n", "words"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(wanted), "doc_id", "left_semi")
    rows = texts.mapInArrow(sets, f"doc_id {kind}, n bigint, words binary")
    return written(rows.groupBy("doc_id").agg(F.min(F.struct("n", "words")).alias("r")).select("doc_id", "r.n", "r.words"), "word-rows")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> dict:
    """The model: sorted word hashes, their weights, thresholds, cut.

    ``labels`` has doc_id, toxic and quality; labels without an id or a toxic flag, and those of no row, are not used. Labels of
    one id count as toxic, and as of low quality, if one of them is. A null text has no words. Without labelled rows nothing is toxic.
    """
    labelled = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    order = F.xxhash64(F.lit(23), F.col("_l"))
    n = labelled.count()
    picked = bounded_sample(labelled, sample, order, n).withColumns({"order": order, "held": F.pmod(F.xxhash64(F.lit(29), F.col("_l")), F.lit(4)) == 0}).collect()
    truth = {r["_l"]: (r["order"], int(r["toxic"] > 0) * (1 + int(r["quality"] == 0))) for r in picked if not r["held"]}
    none = {"words": np.zeros(0, K.U64), "w": np.zeros(0), "t": np.full(GRADES - 1, 50.0), "cut": 0.5}
    if not truth:
        return none
    table = word_rows(docs, list(truth), id_col, text_col)
    # the rows of smallest hash, as many as have ``sample_words`` words in all
    sizes = sorted((truth[r["doc_id"]][0], r["doc_id"], r["n"]) for r in table.select("doc_id", "n").collect())
    fitted = [x for x, total in zip(sizes, np.cumsum([n for _, _, n in sizes]).tolist(), strict=True) if total <= sample_words]
    if not fitted:
        return none
    got = table.withColumn("order", F.xxhash64(F.lit(23), F.col("doc_id"))).filter(F.col("order") <= F.lit(fitted[-1][0])).select("order", "doc_id", "words").toArrow()
    at, ids = np.argsort(got.column("order").to_numpy(), kind="stable").tolist(), got.column("doc_id").to_pylist()
    words = [np.frombuffer(got.column("words")[i].as_buffer(), K.U64) for i in at]
    y = np.array([truth[ids[i]][1] for i in at], np.int64)
    fitted = [ids[i] for i in at]
    flat = np.concatenate(words)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in words])
    del got, words
    weight = copy_weights(minima_keys(row, flat, len(y)))
    uniq, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count >= min(MIN_DOCS, max(2, len(y) // 50))
    place = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)[inverse]
    del flat, inverse
    row, col, used = row[place >= 0], place[place >= 0], uniq[use]
    w, t = fit_ordinal(row, col, y, len(used), weight, penalty=penalties(row, col, y, len(used), weight))
    model = {"words": used[w != 0], "w": w[w != 0], "t": t}
    return model | {"cut": best_cut(*calibration(docs, labelled, model, fitted, id_col, text_col, n))}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (the id by default) with expected_severity, p_toxic, grade (most likely), toxic and kept.

    A null or empty text has no features and the base rate's score. A text is toxic where p_toxic is above the cut; one that
    ties with it stays. Texts are scored whole, however long. Rows stay as they are: repeated rows and rows with a null id are scored like
    others, an empty table gives no rows. Columns of the input named like an output column are left out of ``carry``.
    """
    made = ["expected_severity", "p_toxic", "grade", "toxic", "kept"]
    carry = [c for c in (carry or [id_col]) if c not in made]
    kinds = dict(docs.dtypes)
    shared = broadcast_value(docs.sparkSession, {k: model[k] for k in ("words", "w", "t", "cut")})
    names = [f"c{i}" for i in range(len(carry))]

    def score(batches):
        m = shared.value
        for b in batches:
            row, place = word_sets(b.column("_text"), m["words"])
            z = np.bincount(row, m["w"][place], minlength=b.num_rows) if len(row) else np.zeros(b.num_rows)
            above = np.column_stack([np.ones(b.num_rows), logistic(z[:, None] - m["t"]), np.zeros(b.num_rows)])
            each = above[:, :-1] - above[:, 1:]
            toxic = above[:, 1] > m["cut"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(each @ np.arange(each.shape[1])), pa.array(above[:, 1]), pa.array(each.argmax(1).astype(np.int32)), pa.array(toxic), pa.array(~toxic)], [*names, *made])

    narrow = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(carry)], "expected_severity double, p_toxic double, grade int, toxic boolean, kept boolean"])
    return narrow.mapInArrow(score, schema).toDF(*carry, *made)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Trains on the labelled rows and scores every row; ``train`` and ``score_toxicity`` say what nulls, ties, repeated rows and clashing names give."""
    return score_toxicity(docs, train(docs, labels, id_col, text_col), id_col, text_col, carry)
