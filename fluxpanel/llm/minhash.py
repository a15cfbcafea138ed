"""Near duplicates by word shingles: universal hash minima, banding, verification on full sets, connected components.

1. One pass makes each text's set size, a digest of its set and ``BANDS`` band keys of ``ROWS`` minima each. Texts of one
   set count as one from here on.
2. Texts that share a band key are candidates. Each is tied to the smallest text under its key only, so the ties grow
   with the rows, not with their pairs. Sets of candidates alone are made in a second pass: a bitmap of 32 bits a candidate,
   MAX_BITS at most, picks them; a false positive costs a set that is written and not used, never a result.
3. Ties are verified on full sets; large groups are dealt to several tasks, each with the pivot's set. Verified ties
   give components.
4. Where a group of candidates is in several components, a link between two texts that are not the pivot may be
   missing. A group is a cluster of candidates or, where that takes fewer comparisons, the texts tied to one pivot. Its
   texts are dealt into blocks (large components into blocks of their own), every pair of blocks that could join two
   components is compared on full sets, and each pair emits a spanning forest of the links it found, not all of them.
   Components over all links are the result.

Only pairs that share no band key by chance are missed: (1 - s**ROWS)**BANDS, 2e-8 at similarity 0.85 and 3e-6 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .shared import broadcast_value, written

ROWS, BANDS = 4, 24
#: Texts of a block, and shingles of its texts: a task gets one pair of blocks or several.
BLOCK, BLOCK_SHINGLES = 256, 1 << 22
MAX_BITS = 1 << 30
COLUMNS = 4096


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of each text's distinct shingles, ascending; a text of fewer words has its whole sequence."""
    s, e, woff = K.split(data, at)
    h = K.span_hashes(data, s, e, lower=True)
    first, w = K.windows(h, woff, size, 31)
    doc = np.searchsorted(woff, first, "right") - 1
    n = np.diff(woff)
    for m in range(1, size):
        short = np.flatnonzero(n == m)
        if len(short):
            doc, w = np.concatenate([doc, short]), np.concatenate([w, K.window_hash(h, woff[short], m, 31 + m)])
    order = np.lexsort((w, doc))
    doc, w = doc[order], w[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return w[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BANDS keys of each text; of an empty set, zeros."""
    n = len(off) - 1
    full = np.flatnonzero(np.diff(off))
    keys = np.zeros((n, BANDS), K.U64)
    if not len(full):
        return keys
    mul, add, tmp, begin = K.numbers(ROWS * BANDS, 41) | K.U64(1), K.numbers(ROWS * BANDS, 42), np.empty_like(sets), off[full]
    for band in range(BANDS):
        acc = np.full(len(full), band + 1, K.U64)
        for r in range(ROWS):
            i = band * ROWS + r
            np.multiply(sets, mul[i], out=tmp)
            tmp += add[i]
            acc = K.mix(acc) + np.minimum.reduceat(tmp, begin)
        keys[full, band] = K.mix(acc)
    return keys


def _scan(size: int):
    def run(batches):
        for b in batches:
            for i, n, data, at in K.slices(K.texts(b.column("text")), 1 << 20):
                sets, off = shingle_sets(data, at, size)
                count = np.diff(off)
                two = np.zeros((n, 2), K.U64)
                full = np.flatnonzero(count)
                if len(full):
                    two[full, 0], two[full, 1] = np.add.reduceat(K.mix(sets), off[full]), np.add.reduceat(K.mix(sets ^ K.U64(0x5851F42D4C957F2D)), off[full])
                raw = two.tobytes()
                keys = _signatures(sets, off).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, n), pa.array(count), pa.array([raw[16 * j : 16 * j + 16] for j in range(n)], pa.binary()), bands], ["id", "n", "digest", "bands"])

    return run


def _bitmap(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, bytes) with the hashed places of n ids set; at most MAX_BITS / 8 bytes come to the driver."""
    bits = min(MAX_BITS, max(1 << 15, 1 << (32 * max(n, 1) - 1).bit_length()))
    rows = ids.select(F.xxhash64("id").bitwiseAND(F.lit(bits - 1)).alias("p")).groupBy(F.shiftright("p", 15).alias("s")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["s"] * 4096 : (r["s"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return bits, out


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _verify_ties(percent: int):
    """Rows sorted by (pivot, salt, place): place 0 has the pivot's set, the rest members'. Emits verified ties."""

    def run(batches):
        key, bases = None, []
        for b in batches:
            pivots, salts, place, ids, sets = b.column("pivot").to_pylist(), b.column("salt").to_pylist(), b.column("place").to_pylist(), b.column("id").to_pylist(), b.column("set")
            out_a, out_b = [], []
            for i in range(b.num_rows):
                s = np.frombuffer(sets[i].as_buffer(), K.U64)
                if place[i] == 0:  # rows that share the pivot's id have a set each
                    if key != (pivots[i], salts[i]):
                        key, bases = (pivots[i], salts[i]), []
                    bases.append(s)
                    continue
                for base in bases if key == (pivots[i], salts[i]) else []:
                    at = np.minimum(np.searchsorted(base, s), len(base) - 1)
                    if linked(int((base[at] == s).sum()), len(s), len(base), percent):
                        out_a.append(ids[i])
                        out_b.append(pivots[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, b.schema.field("id").type), pa.array(out_b, b.schema.field("id").type)], ["a", "b"])

    return run


def block_links(sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of links between texts of different groups: within one block (all sides equal), or across two sides."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    row, col = row[shared], col[shared]
    if not len(row):
        return []
    col = np.cumsum(np.concatenate([[True], col[1:] != col[:-1]])) - 1
    left, right = (np.arange(m), np.arange(m)) if (side == side[0]).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    inter = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(col[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(col, [c, c + COLUMNS])
        x = np.zeros((m, min(COLUMNS, int(col[-1]) + 1 - c)), np.float32)
        x[row[i:j], col[i:j] - c] = 1
        inter += x[left] @ x[right].T
    ok = linked(inter.astype(np.int64), n[left][:, None], n[right][None, :], percent) & (group[left][:, None] != group[right][None, :])
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = root.get(root[g], root[g])
            g = root[g]
        return g

    out = []
    for p, q in zip(*np.nonzero(ok), strict=True):
        i, j = int(left[p]), int(right[q])
        a, b = find(int(group[i])), find(int(group[j]))
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def _verify_blocks(percent: int):
    """Rows sorted by unit (cluster, i, j); a unit has the texts of one block or two. Emits pairs of components that a link joins."""

    def run(batches):
        key, held = None, []

        def done():
            links = []
            if len(held) > 1:
                sides = np.array([h[1] for h in held])
                links = block_links([h[3] for h in held], sides, np.array([h[2] for h in held]), percent)
            return [held[i][2] for i, _ in links], [held[j][2] for _, j in links]

        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            rows = zip(b.column("cluster").to_pylist(), b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("side").to_pylist(), b.column("id").to_pylist(), b.column("component").to_pylist(), b.column("set"), strict=True)
            for cluster, i, j, side, doc, comp, s in rows:
                if (cluster, i, j) != key:
                    a, c = done()
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind)], ["a", "b"])
                    key, held = (cluster, i, j), []
                held.append((doc, side, comp, np.frombuffer(s.as_py(), K.U64)))
        a, c = done()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind)], ["a", "b"])

    return run


def by_cheaper_groups(ties: DataFrame, where: DataFrame, block: int) -> DataFrame:
    """(id, cluster, component) to compare: texts by their cluster or, where that takes fewer comparisons, by pivot.

    A cluster is a chain of candidates and may grow with the corpus while each pivot has few ties. Candidates share a key, so
    they share its pivot, and both ways compare them all; pivots whose texts are in one component already are left out.
    """
    cost = lambda n: F.col(n) * F.ceil(F.col(n) / F.lit(block))
    spread = [F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")]
    wide = written(where.groupBy("cluster").agg(*spread).filter((F.col("low") < F.col("high")) & (F.col("n") > block)).select("cluster", cost("n").alias("whole")), "wide")
    if not wide.head(1):
        return where
    star = ties.select("id", "pivot").unionByName(ties.select(F.col("pivot").alias("id"), "pivot").distinct())
    star = written(star.join(where.join(wide, "cluster").select("id", "cluster", "component"), "id"), "star")
    mixed = written(star.groupBy("cluster", "pivot").agg(*spread).filter("low < high").select("cluster", F.col("pivot").alias("p"), cost("n").alias("part")), "mixed")
    less = wide.join(mixed.groupBy("cluster").agg(F.sum("part").alias("parts")), "cluster", "left").filter(F.coalesce("parts", F.lit(0)) < F.col("whole"))
    less = written(less.select("cluster"), "less")
    pivots = written(mixed.join(less, "cluster").select("p"), "split")
    # a pivot's number is a cluster's number only in a cluster that is split
    split = star.join(pivots, F.col("pivot") == F.col("p")).select("id", F.col("pivot").alias("cluster"), "component")
    return written(where.join(less, "cluster", "left_anti").select("id", "cluster", "component").unionByName(split), "where")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """id, n_shingles, component_id, kept of every row; ids are whole numbers.

    Texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``size``-word shingles, A-Z lower-cased.
    A text of fewer words has its whole sequence as its one shingle; a null, empty or blank text has none and is linked
    with nothing. Ids should be unique; where rows share one, each row is judged by its own text (one without words by itself), but an id that
    stands for several texts joins their components. Of a component, the row (or rows) of the smallest id is kept; equal texts are one component. A row with a null id has a null
    component and is kept. Texts are read whole, however long. Columns other than the two named are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = written(narrow.mapInArrow(_scan(size), "id bigint, n bigint, digest binary, bands array<bigint>"), "minhash")
    # 1. one representative for each set
    real = table.filter("n > 0 and id is not null")
    groups = written(real.groupBy("digest").agg(F.min("id").alias("rep")), "sets")
    member = written(real.select("id", "n", "digest", "bands").join(groups, "digest").select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "member")
    reps = member.filter("bands is not null").select("id", "bands")
    # 2. ties to the smallest text under each key
    keys = reps.select("id", F.explode("bands").alias("key"))
    pivots = written(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last").select(F.col("key").alias("k"), "pivot"), "pivots")
    ties = written(keys.join(pivots, F.col("key") == F.col("k")).filter("id <> pivot").select("id", "pivot").distinct(), "ties")
    inside = written(ties.select("id").unionByName(ties.select(F.col("pivot").alias("id"))).distinct(), "inside")
    bits, bitmap = _bitmap(inside, inside.count())
    chosen = broadcast_value(spark, bitmap)

    def sets_of(batches):
        for b in batches:
            place = b.column("place").to_numpy()
            keep = np.flatnonzero(chosen.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            b = b.take(pa.array(keep))
            for i, n, data, at in K.slices(K.texts(b.column("text")), 1 << 20):
                sets, off = shingle_sets(data, at, size)
                full = np.flatnonzero(np.diff(off))  # an id may stand for an empty text too; that links nothing
                raw, off = sets.tobytes(), (off * 8).tolist()
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, n).take(pa.array(full)), pa.array([raw[off[j] : off[j + 1]] for j in full.tolist()], pa.binary())], ["id", "set"])

    placed = narrow.filter("id is not null").withColumn("place", F.xxhash64("id").bitwiseAND(F.lit(bits - 1)))
    sets = written(placed.mapInArrow(sets_of, "id bigint, set binary"), "candidates")
    # 3. verified ties
    fan = ties.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("salts"))
    tied = ties.join(sets, "id").select("pivot", F.col("id"), "set")
    tied = tied.join(fan, "pivot").select("pivot", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(1).alias("place"), "id", "set")
    heads = fan.join(sets, fan["pivot"] == sets["id"]).select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("place"), "id", "set")
    dealt = heads.unionByName(tied).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "place", "id")
    links = written(dealt.mapInArrow(_verify_ties(percent), "a bigint, b bigint").distinct(), "links")
    first = written(components(links), "component")
    # 4. candidate groups that are in several components
    cluster = written(components(ties, "id", "pivot"), "cluster")
    where = cluster.select("node", F.col("component").alias("cluster")).join(first, "node", "left").select(F.col("node").alias("id"), "cluster", F.coalesce("component", "node").alias("component"))
    where = by_cheaper_groups(ties, written(where, "where"), block)
    # a block has ``block`` texts or ``shingles`` shingles, whichever is less, so that very long texts get more blocks
    weight = member.filter("bands is not null").groupBy(F.col("id").alias("_i")).agg((F.lit(1.0) / block + F.sum("n") / F.lit(float(shingles))).alias("w"))
    parts = where.join(weight, F.col("id") == F.col("_i")).groupBy("cluster", "component").agg(F.sum("w").alias("w"))
    parts = written(parts.withColumn("big", F.col("w") >= 1), "parts")
    from pyspark.sql import Window

    starts = Window.partitionBy("cluster").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    small = parts.filter("not big").groupBy("cluster").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c")).select("cluster", F.ceil("w").alias("pools"), "c")
    big = parts.filter("big").withColumn("own", F.ceil("w"))
    shape = big.groupBy("cluster").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("bigs"))
    shape = small.join(shape, "cluster", "full_outer").select("cluster", F.coalesce("pools", F.lit(0)).alias("pools"), (F.coalesce("pools", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("blocks"), (F.coalesce("c", F.lit(0)) + F.coalesce("bigs", F.lit(0))).alias("comps"))
    shape = written(shape.filter("comps > 1"), "shape")
    big = written(big.withColumn("at", F.coalesce(F.sum("own").over(starts), F.lit(0))).select("cluster", "component", "own", "at"), "big")
    rows = where.join(shape, "cluster").join(big, ["cluster", "component"], "left")
    mine = F.when(F.col("own").isNotNull(), F.col("pools") + F.col("at") + F.pmod(F.xxhash64("id"), "own")).otherwise(F.pmod(F.xxhash64("component", F.lit(3)), "pools"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.filter(F.col("own").isNull() | (F.col("other") < F.col("pools") + F.col("at")) | (F.col("other") >= F.col("pools") + F.col("at") + F.col("own")))
    units = rows.select("id", "component", "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    # the pairs of blocks of a cluster are dealt to the tasks in turn, from a place that its hash gives: their number is what makes a cluster heavy
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.expr("j * (j + 1) div 2 + i"), F.lit(tasks)) + F.pmod(F.xxhash64("cluster"), F.lit(tasks))
    units = units.join(sets, "id").repartitionById(tasks, F.pmod(turn, F.lit(tasks)).cast("int")).sortWithinPartitions("cluster", "i", "j")
    # links between components join whole components; most often there are few
    more = components(units.mapInArrow(_verify_blocks(percent), "a bigint, b bigint"))
    more = more.select(F.col("node").alias("c"), F.col("component").alias("joined"))
    final = first.join(more, F.col("component") == F.col("c"), "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = more.join(first, F.col("c") == F.col("node"), "left_anti").select(F.col("c").alias("node"), F.col("joined").alias("component"))
    final = written(final.unionByName(alone), "component")
    # a set's copies share its representative's component
    out = member.join(final, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(table.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
