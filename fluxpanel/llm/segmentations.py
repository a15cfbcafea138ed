"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by a perturbed A-star search over the lattice.

The lattice of a text has a node at each character and an edge for each piece of the vocabulary that fits. Edge weights are
log probabilities by the piece's rank, log(1 / (rank + SHIFT)) normalised (the vocabulary's own scores are merge ranks, so
Zipf's law stands in for counts; nothing is trained). A backward pass turns weights into the exact probability of each edge
given its node, the search's heuristic.

The search keeps disjoint sets of paths, each with its log mass, its best perturbed score and, once taken from the
queue, the path that has it. The set of all paths comes first, with a Gumbel score. A set that is taken emits its path and is
split by the first step at which a path leaves the emitted one; each part gets a Gumbel score with its log mass as
location, cut off at the score of the set it came from. The k sets taken first give k distinct paths, drawn without
replacement; the score that would come next is the threshold of the inclusion scores 1 - exp(-exp(log p - threshold)).

No piece of the vocabulary crosses certain byte pairs (before a space, mostly), so the lattice falls into units there, and
each distinct unit's lattice is built once for a worker, and again after its edges have passed ``KEPT``. Random numbers are a hash of row key, sample, unit and step:
the same row gives the same samples wherever it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SHIFT = 2.7
SAMPLES = 3
#: Edges that a worker keeps (28 bytes each) before it builds its lattices anew; a slice of texts may add its own to them.
KEPT = 3_000_000
SLICE = 1 << 20
SPACE_MARK = "▁".encode()


def _number(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a hash of 64-bit keys."""
    return ((K.mix(x) >> K.U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _salted(seed: np.ndarray, *salts: int) -> np.ndarray:
    """Seeds for one use of them; keys made by adding small numbers don't meet those of another use."""
    for s in salts:
        seed = K.mix(seed ^ K.U64(0x9E3779B97F4A7C15 + s))
    return seed


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges begin..begin+size, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Lattices:
    """The vocabulary, and the lattices of the units met so far, in flat arrays of nodes (byte places) and edges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_of = [b"" if special[i] else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[self.bytes_of[i][0]] = i
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        total = np.log(sum(1 / (r + SHIFT) for r in range(len(plain) + 1)))
        self.weight = np.zeros(n)
        for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i))):
            self.weight[i] = -np.log(r + SHIFT) - total
        self.unknown = float(-np.log(len(plain) + SHIFT) - total)
        self.piece = {self.bytes_of[i]: i for i in plain}
        self.joined = np.zeros((256, 256), bool)
        for p in self.piece:
            for x, y in zip(p, p[1:], strict=False):
                self.joined[x, y] = True
        self.joined[:, 0x80:0xC0] = True  # within a character
        # prefixes of pieces by the raw sum of kernel.span_hashes, with the piece's id or -1
        prefixes = sorted({p[:j] for p in self.piece for j in range(1, len(p) + 1)})
        self.longest = max(map(len, prefixes))
        mul = K.place(self.longest)
        sums = np.array([int(sum((int(K.BYTE[c]) * int(mul[j]) for j, c in enumerate(p)), 0) & (2**64 - 1)) for p in prefixes], K.U64)
        order = np.argsort(sums)
        self.prefix_keys, self.prefix_id = sums[order], np.array([self.piece.get(prefixes[i], -1) for i in order], np.int32)
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_len = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self._forget()

    def _forget(self) -> None:
        self.keys, self.roots = np.zeros(0, K.U64), np.zeros(0, np.int64)
        self.nodes, self.edges = 0, 0
        self.edge_at = np.zeros(1 << 16, np.int32)
        self.cdf, self.logq, self.logrest = np.zeros(1 << 17, np.float32), np.zeros(1 << 17), np.zeros(1 << 17, np.float32)
        self.source, self.target, self.id = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32)

    def _set(self, name: str, at: int, values: np.ndarray) -> None:
        a = getattr(self, name)
        while len(a) < at + len(values):
            a = np.concatenate([a, np.zeros_like(a)])
        a[at : at + len(values)] = values
        setattr(self, name, a)

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Builds the lattices of new units (ascending keys); the roots of each."""
        size = ends - starts
        total = int(size.sum())
        roots = np.cumsum(size) - size
        within = np.arange(total) - np.repeat(roots, size)
        b = data[within + np.repeat(starts, size)]
        left = np.repeat(size, size) - within
        # edges: pieces that start at each place, found by growing prefixes
        at = np.flatnonzero((b & 0xC0) != 0x80)
        live, acc, mul = at, np.zeros(len(at), K.U64), K.place(self.longest)
        src, end, ids = [], [], []
        char = np.ones(total, np.int64)
        char[at] = np.minimum(np.diff(np.append(at, total)), left[at])
        whole = np.zeros(total, bool)
        for n in range(1, self.longest + 1):
            ok = left[live] >= n
            live, acc = live[ok], acc[ok]
            if not len(live):
                break
            acc = acc + K.BYTE[b[live + n - 1]] * mul[n - 1]
            pos = np.minimum(np.searchsorted(self.prefix_keys, acc), len(self.prefix_keys) - 1)
            ok = self.prefix_keys[pos] == acc
            live, acc, pos = live[ok], acc[ok], pos[ok]
            hit = np.flatnonzero(self.prefix_id[pos] >= 0)
            src.append(live[hit])
            end.append(live[hit] + n)
            ids.append(self.prefix_id[pos[hit]])
            whole[live[hit][char[live[hit]] == n]] = True
        lone = np.flatnonzero(~whole)  # a character without a piece, and the bytes inside of characters
        first = (b[lone] & 0xC0) != 0x80
        # edges by their place, long pieces (the likely ones) first: each group below has a place once at most
        groups = [*reversed(list(zip(src, end, ids, strict=True))), (lone, lone + 1, self.byte_id[b[lone]])]
        seen = np.zeros(total, np.int64)
        for g in groups:
            seen[g[0]] += 1
        begin = np.concatenate([[0], np.cumsum(seen)])
        src, end, ids, w = np.repeat(np.arange(total), seen), np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int32), np.empty(begin[-1])
        seen = begin[:-1].copy()
        for i, (at, to, piece) in enumerate(groups):
            put = seen[at]
            end[put], ids[put] = to, piece
            w[put] = self.weight[piece] if i + 1 < len(groups) else np.where(first, self.unknown, 0.0)
            seen[at] += 1
        # backward pass, by bytes left in the unit
        over = end == src + left[src]
        rank = left.astype(np.uint16) if total and left.max() < 1 << 16 else left  # short keys are sorted by digits
        nodes = np.argsort(rank, kind="stable")
        level = np.concatenate([[0], np.flatnonzero(np.diff(left[nodes])) + 1, [total]])
        size = np.diff(begin)
        beta, x = np.zeros(total + 1), np.empty(len(src))
        for i, j in zip(level[:-1], level[1:], strict=True):
            u = nodes[i:j]
            m = size[u]
            e = _ranges(begin[u], m)
            y = w[e] + np.where(over[e], 0.0, beta[end[e]])
            from_ = np.cumsum(m) - m
            top = np.maximum.reduceat(y, from_)
            beta[u] = top + np.log(np.add.reduceat(np.exp(y - np.repeat(top, m)), from_))
            x[e] = y
        logq = np.minimum(x - beta[src], 0.0)
        q = np.exp(logq)
        run = np.concatenate([[0.0], np.cumsum(q)])
        cdf = run[1:] - run[begin[src]]
        cdf[begin[1:] - 1] = 2.0
        one = np.diff(begin)[src] == 1
        logq[one] = 0.0
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(np.exp(logq), 1.0))
        rest[one] = -np.inf
        self._set("edge_at", self.nodes, (begin + self.edges).astype(np.int32))
        for name, values in (("cdf", cdf), ("logq", logq), ("logrest", rest), ("source", src + self.nodes), ("target", np.where(over, -1, end + self.nodes)), ("id", ids)):
            self._set(name, self.edges, values)
        roots = roots + self.nodes
        self.nodes, self.edges = self.nodes + total, self.edges + len(src)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.roots = np.insert(self.keys, at, keys), np.insert(self.roots, at, roots)
        return roots

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(root of each unit, unit offsets by text)."""
        if self.edges > KEPT:
            self._forget()
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        uniq, first, inverse = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        roots = np.full(len(uniq), -1)
        if len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
            roots = np.where(self.keys[pos] == uniq, self.roots[pos], -1)
        new = np.flatnonzero(roots < 0)
        if len(new):
            roots[new] = self.learn(uniq[new], data, starts[first[new]], ends[first[new]])
        return roots[inverse], np.searchsorted(starts, at)

    def walk(self, node: np.ndarray, unit: np.ndarray, step: np.ndarray, seed: np.ndarray) -> tuple[list, list, list]:
        """Samples from the given nodes to the ends of their units: lists of (unit, step, edge) arrays; ``seed`` by walker."""
        us, ss, es = [], [], []
        while len(node):
            edge = self.edge_at[node].astype(np.int64)
            many = np.flatnonzero(self.edge_at[node + 1] - edge > 1)
            u = _number(seed[many] + step[many].astype(K.U64))
            at, live = edge[many], np.arange(len(many))
            while len(live):
                live = live[u[live] > self.cdf[at[live]]]
                at[live] += 1
            edge[many] = at
            us.append(unit)
            ss.append(step)
            es.append(edge)
            node = self.target[edge]
            go = np.flatnonzero(node >= 0)
            node, unit, step, seed = node[go], unit[go], step[go] + 1, seed[go]
        return us, ss, es

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by text) of piece ids."""
        n = self.byte_len[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat_bytes[np.repeat(self.byte_at[ids] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.concatenate([[0], np.cumsum(counts)])]


_known: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    """One vocabulary for a worker process."""
    if path not in _known:
        _known[path] = Lattices(path)
    return _known[path]


def prepared(texts: pa.Array, i: int, n: int, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The library's form of texts: a space before each text that is not empty; U+2581 counts as a space."""
    if ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
        parts = [t.as_py().replace(SPACE_MARK, b" ") for t in texts.slice(i, n)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    full = np.diff(at) > 0
    return np.insert(data, at[:-1][full], 32), at + np.concatenate([[0], np.cumsum(full)])


def sample_texts(lat: Lattices, data: np.ndarray, at: np.ndarray, seed: np.ndarray, k: int):
    """([(texts that have the sample, ids, ids of each text, log p, perturbed score)], threshold by text).

    ``data`` is in the library's form; ``seed`` is a number for each text. A level is a step of a path through a whole text.
    """
    n = len(at) - 1
    root, uoff = lat.units(data, at)
    per = np.diff(uoff)
    place = (np.arange(len(root)) - np.repeat(uoff[:-1], per)).astype(K.U64)
    queue: list[list] = [[] for _ in range(n)]  # (score, sample, level, edges left out at it)
    live = np.arange(n)
    score = -np.log(-np.log(_number(_salted(seed, 1))))
    walker = K.mix(np.repeat(_salted(seed, 2, 0), per) + place)
    us, ss, es = lat.walk(root, np.arange(len(root)), np.zeros(len(root), np.int64), walker)
    left: list = [()] * n
    level = np.full(n, -1)  # where the sample left its parent
    edges, units, steps, offs, base, emitted = [], [], [], [], [0], []
    for j in range(k):
        none = np.zeros(0, np.int64)
        unit, step, edge = (np.concatenate([none, *x]) for x in (us, ss, es))
        count = np.bincount(unit, minlength=len(root))
        uat = np.cumsum(count) - count
        put = np.empty(len(edge), np.int64)
        put[uat[unit] + step] = np.arange(len(edge))
        unit, step, edge = unit[put], step[put], edge[put]
        off = np.append(uat, len(edge))[uoff] if len(root) else np.zeros(n + 1, np.int64)
        size = np.diff(off)
        run = np.concatenate([[0.0], np.cumsum(lat.logq[edge])])
        logp = run[off[1:]] - run[off[:-1]]
        emitted.append((live, lat.id[edge], size, logp, score.copy()))
        edges.append(edge), units.append(unit), steps.append(step), offs.append(off), base.append(base[-1] + len(edge))
        # what is left, by the first level that differs: log mass of each part, then a Gumbel number at it
        mass = lat.logrest[edge].astype(float)
        for t in np.flatnonzero(level >= 0).tolist():
            x = int(off[t] + level[t])
            out = [int(edge[x]), *left[t]]
            node = lat.source[edge[x]]
            gone = float(np.exp(lat.logq[out]).sum())
            mass[off[t] : x] = -np.inf
            mass[x] = -np.inf if lat.edge_at[node + 1] - lat.edge_at[node] == len(out) or gone >= 1 else np.log1p(-gone)
        doc = np.repeat(np.arange(n), size)
        mass = mass + run[:-1] - np.repeat(run[off[:-1]], size)
        open_ = np.flatnonzero(mass > -np.inf)
        d = doc[open_]
        gumbel = mass[open_] - np.log(-np.log(_number(np.repeat(_salted(seed, 3, j), size)[open_] + (open_ - off[d]).astype(K.U64))))
        for _ in range(k - j):
            if not len(open_):
                break
            begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            best = np.maximum.reduceat(gumbel, begin)
            top = np.flatnonzero(gumbel == np.repeat(best, np.diff(np.append(begin, len(d)))))
            top = top[np.concatenate([[True], d[top][1:] != d[top][:-1]])]
            cut_off = -np.logaddexp(-score[d[top]], -gumbel[top])  # a Gumbel number conditioned to stay below the set's score
            for t, x, g in zip(d[top].tolist(), open_[top].tolist(), cut_off.tolist(), strict=True):
                v = x - int(off[t])
                queue[t].append((g, j, v, (int(edge[x]), *(left[t] if v == level[t] else ()))))
            gumbel[top] = -np.inf
            if (gumbel == -np.inf).all():
                break
            if len(top) == len(open_):
                break
            keep = np.ones(len(d), bool)
            keep[top] = False
            open_, d, gumbel = open_[keep], d[keep], gumbel[keep]
        if j + 1 == k:
            break
        live = np.array([t for t in range(n) if queue[t]], np.int64)
        score, level, left = np.full(n, -np.inf), np.full(n, -1), [()] * n
        parents, chosen = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        draw = _number(_salted(seed[live], 4, j))
        for x, t in enumerate(live.tolist()):
            best = max(range(len(queue[t])), key=lambda y: queue[t][y][0])
            score[t], parents[x], level[t], left[t] = queue[t].pop(best)
            node = int(lat.source[left[t][0]])
            options = [e for e in range(lat.edge_at[node], lat.edge_at[node + 1]) if e not in left[t]]
            p = np.exp(lat.logq[options])
            chosen[x] = options[min(int(np.searchsorted(np.cumsum(p), draw[x] * p.sum(), "right")), len(options) - 1)]
        # prefixes of the parents' paths, the edge that differs, then the rest of its unit and all later units anew
        every = np.concatenate(edges), np.concatenate(units), np.concatenate(steps)
        begin = np.array(base)[parents] + np.array([offs[p][t] for p, t in zip(parents.tolist(), live.tolist(), strict=True)], np.int64)
        where = begin + level[live]
        same = _ranges(begin, level[live])
        unit, step = every[1][where], every[2][where]
        target = lat.target[chosen]
        go = np.flatnonzero(target >= 0)
        later = uoff[live + 1] - unit - 1
        fresh = _ranges(unit + 1, later)
        walker = np.concatenate([_salted(seed[live[go]], 2, j + 1) + place[unit[go]], np.repeat(_salted(seed[live], 2, j + 1), later) + place[fresh]])
        more = lat.walk(np.concatenate([target[go], root[fresh]]), np.concatenate([unit[go], fresh]), np.concatenate([step[go] + 1, np.zeros(len(fresh), np.int64)]), K.mix(walker))
        us, ss, es = [every[1][same], unit, *more[0]], [every[2][same], step, *more[1]], [every[0][same], chosen, *more[2]]
    return emitted, np.array([max((x[0] for x in q), default=-np.inf) for q in queue])


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, roundtrip and, on request, ids.

    Up to k rows a text, in the order of their perturbed scores; fewer where it has fewer segmentations (their inclusion
    is certain). A null or empty text has the one empty segmentation. roundtrip says that the decoded ids are the text
    in the library's form. Rows that share an id and text get the same samples. A null id stays null, and its text is the row key.
    Equal scores go to the earlier step. Texts are sampled whole, however long. Columns other than the two named are not read, whatever
    their names. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        lat = lattices(model)
        for b in batches:
            texts = K.texts(b.column("text"))
            seeds = b.column("seed").to_numpy().astype(K.U64)
            for i, n, data, at in K.slices(texts, SLICE):
                data, at = prepared(texts, i, n, data, at)
                emitted, threshold = sample_texts(lat, data, at, seeds[i : i + n], k)
                raw = data.tobytes()
                for j, (live, ids, counts, logp, score) in enumerate(emitted):
                    plain, off = lat.decode(ids, counts)
                    plain, edge = plain.tobytes(), np.concatenate([[0], np.cumsum(counts)])
                    packed = memoryview(ids.astype("<u4").tobytes())
                    ok = [plain[off[t] : off[t + 1]] == raw[at[t] : at[t + 1]] for t in live.tolist()]
                    crc = [zlib.crc32(packed[4 * edge[t] : 4 * edge[t + 1]]) for t in live.tolist()]
                    gap = logp[live] - threshold[live]
                    with np.errstate(over="ignore", divide="ignore"):
                        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700.0)))))
                    cols = [b.column("doc_id").take(pa.array(live + i)), pa.array(np.full(len(live), j + 1, np.int32)), pa.array(counts[live]), pa.array(logp[live]), pa.array(score[live]), pa.array(inclusion), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids)).take(pa.array(live)))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "roundtrip", *["ids"] * with_ids])

    # the row key is the id; the text joins it only where ids are null
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))).alias("seed"))
    return keyed.mapInArrow(run, f"doc_id {kind}, sample int, n_pieces bigint, log_prob double, perturbed double, log_inclusion double, ids_crc32 bigint, roundtrip boolean" + ", ids array<int>" * with_ids)


def encode_best(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the library's own encoding (ids) of each whole text; of a null or empty one, no ids. Rows stay as they are, repeated ones too."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(sp.encode([t or "" for t in c.column("text").to_pylist()], num_threads=1), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids, by the library; a null list gives null. A column named like ``out_col`` is replaced."""
    import json

    rows = rows.drop(out_col)
    schema = json.loads(rows.schema.json())
    schema["fields"].append({"name": out_col, "type": "string", "nullable": True, "metadata": {}})
    from pyspark.sql.types import StructType

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            text = [None if x is None else sp.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, out_col])

    return rows.mapInArrow(run, StructType.fromJson(schema))
