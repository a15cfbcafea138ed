"""Repeated passages: anchors at the places of a difference cover, extended to full windows where an anchor repeats.

COVER is a perfect difference set modulo PERIOD: for any two places i, j some shift d < PERIOD takes both into the
cover. So two equal windows of ``window`` words share an anchor of ``window - PERIOD + 1`` words that starts at a cover place
in both, and only 4 of 13 places need an anchor.

1. Texts are stored in chunks in the shared folder. A table has the chunks of the tasks that finished, so that whatever runs
   again later finds the same ones. The chunks of a task are a group: it sends its distinct anchors, by hash, to buckets, those
   that several of its texts have apart; a bucket sends back those that are in more than one text.
2. Each chunk extends its repeated anchors to the windows around them and keeps the earliest of each window it holds. It
   sends one row of numbers for each distinct window to buckets; a bucket finds the earliest chunk and sends back which
   windows the others lose.
3. Each chunk removes the words of the windows it lost, to itself or to others.

A passage in very many texts costs each group one anchor and each chunk one window, and a bucket never gathers its rows: it
takes them in parts of PART_BYTES and keeps one entry for each distinct key, with the group that has it first or the earliest chunk.
Hashes spread distinct keys evenly, so a bucket stays within its share however often a key comes. Nothing is paired.
Anchors have 64-bit hashes (a clash costs some work, never a result), windows 96-bit ones. Rows between chunks and buckets are
far smaller than the work they stand for, so the numbers of tasks are given and not left to the rows' size.
"""

from __future__ import annotations

import hashlib
import io
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import get, new_path, put, written

PERIOD, COVER = 13, (0, 1, 3, 9)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
CHUNK_BYTES = 6 << 20
#: Text for a bucket: about 0.4 bytes of anchors a byte of text, if all are distinct.
BUCKET_BYTES = 128 << 20
#: Chunks for a task where there are more of them than tasks: so many that a group has several anchors for a bucket at any size.
TASK_CHUNKS = 32
#: Rows that a bucket takes at once.
PART_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
#: ``chunk`` is a group in the first exchange and its answer; ``base`` is -1 in a chunk's or group's own row, which every one has.
ROW = "bucket int, chunk bigint, base int, data binary"


def _row(bucket: int, chunk: int, base: int, data: bytes) -> tuple:
    return bucket, chunk, base, data


def _home(chunk: int, bits: int) -> int:
    """The bucket through which a chunk's own row passes."""
    return (chunk * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    b, c, s, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(s, pa.int32()), pa.array(d, pa.binary())], ["bucket", "chunk", "base", "data"])


def _save(uri: str, table: pa.Table) -> None:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    put(uri, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))


def _load(uri: str) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(get(uri))).read_all()


def _words(col: pa.Array):
    """(word hashes, word offsets by text) of all texts of a chunk."""
    hashes, off, n = [np.zeros(0, K.U64)], [np.zeros(1, np.int64)], 0
    for _, _, data, at in K.slices(K.texts(col)):
        s, e, woff = K.split(data, at)
        hashes.append(K.span_hashes(data, s, e))
        off.append(woff[1:] + n)
        n += len(s)
    return np.concatenate(hashes), np.concatenate(off)


def anchors(h: np.ndarray, woff: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the anchors at cover places of each text that has a window."""
    size = window - PERIOD + 1
    count = np.diff(woff)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - woff[:-1][doc]
    first = np.flatnonzero(IN_COVER[place % PERIOD] & (place + size <= count[doc]) & (count[doc] >= window))
    return first, K.window_hash(h, first, size, 71)


def extended(first: np.ndarray, woff: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that hold one of the given anchors whole."""
    n = int(woff[-1])
    step = np.zeros(n + 1, np.int32)
    doc = np.searchsorted(woff, first, "right") - 1
    low = np.maximum(first - (PERIOD - 1), woff[doc])
    high = np.minimum(first, woff[doc + 1] - window)
    ok = high >= low
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(step)[:n] > 0)


def _rows(batches):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in ("bucket", "chunk", "base", "data")], strict=True)


def _by_chunk(batches):
    """Rows of batches sorted by chunk, gathered: as many as a chunk or a group has sent."""
    for chunk, rows in groupby(_rows(batches), lambda r: r[1]):
        yield chunk, list(rows)


def _parts(batches, most: int):
    """(bucket, rows) of batches sorted by bucket, about ``most`` bytes at a time."""
    for bucket, rows in groupby(_rows(batches), lambda r: r[0]):
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[3]) + 64
            if size >= most:
                yield bucket, held
                held, size = [], 0
        if held:
            yield bucket, held


def _answers(bucket: int, chunk: np.ndarray, values: np.ndarray) -> list[tuple]:
    """A row for each chunk with its values."""
    order = np.argsort(chunk, kind="stable")
    chunk, values = chunk[order], values[order]
    edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
    return [_row(bucket, int(chunk[i]), 0, values[i:j].tobytes()) for i, j in zip(edge, np.append(edge[1:], len(chunk)), strict=False)]


class AnchorBucket:
    """The distinct anchors of a bucket; ``take`` finds which of the next rows' anchors are in more than one text."""

    def __init__(self):
        self.key, self.holder, self.told = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, bool)

    def take(self, key: np.ndarray, group: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, anchor) to tell, each once: the groups of these rows, and the one that had an anchor alone until now."""
        known = len(self.key)
        every, who = np.concatenate([self.key, key]), np.concatenate([self.holder, group])
        sure = np.concatenate([self.told, several])
        quiet = np.concatenate([self.told, np.zeros(len(key), bool)])
        order = np.lexsort((np.arange(len(every)) >= known, every))
        every, who, sure, quiet = every[order], who[order], sure[order], quiet[order]
        first = np.ones(len(every), bool)
        first[1:] = every[1:] != every[:-1]
        run = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        hit = (np.bincount(run) > 1) | (np.bincount(run, sure) > 0)
        tell = hit[run] & ~quiet
        self.key, self.holder, self.told = every[begin], who[begin], hit
        return who[tell], every[tell]


class WindowBucket:
    """The earliest of each distinct window of a bucket; ``take`` finds which windows are later than another."""

    def __init__(self):
        self.k1, self.k2, self.own = np.zeros(0, K.U64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.chunk, self.index = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, k1: np.ndarray, k2: np.ndarray, own: np.ndarray, chunk: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, index) of the windows that these rows, or earlier ones, lose; each is lost once."""
        pairs = [(self.k1, k1), (self.k2, k2), (self.own, own), (self.chunk, chunk), (self.index, index)]
        k1, k2, own, chunk, index = [np.concatenate(p) for p in pairs]
        order = np.lexsort((chunk, own, k2, k1))
        k1, k2, own, chunk, index = [a[order] for a in (k1, k2, own, chunk, index)]
        later = np.zeros(len(k1), bool)
        later[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        self.k1, self.k2, self.own, self.chunk, self.index = [a[~later] for a in (k1, k2, own, chunk, index)]
        return chunk[later], index[later]


def _send(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending 64-bit keys."""
    bucket = (keys >> K.U64(shift)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[i]), int(i), int(j)) for i, j in zip(edge, np.append(edge[1:], len(bucket)), strict=False)]


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: the high ones are mostly zeros and pack well."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """Columns ``carry`` (the id by default) with n_words, n_removed, kept_sha256 and, on request, kept_text.

    A word goes if a run of ``window`` words over it also starts earlier: in a text of a smaller id, or earlier in the same
    text. Rows that share an id, repeated rows too, are ordered by the place they are read from; null ids come last. A null text has no
    words (n_words 0, the digest of nothing). kept_text is the text without the words removed and the white space
    after them, unchanged (null too) where nothing is removed. Ids are whole numbers. A text of any length is worked on whole, in one
    chunk of its own. Columns of the input named like an output column are left out of ``carry``. An empty table gives no rows.
    """
    if window < PERIOD + 1:
        raise ValueError(f"windows need more than {PERIOD} words")
    spark = docs.sparkSession
    made = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    carry = [c for c in (carry or [id_col]) if c not in made]
    kinds = dict(docs.dtypes)
    top = new_path(spark, "passages")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"c{i}" for i in range(len(carry))]
    narrow = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])

    def stored(batches):
        part, attempt, k, held, held_bytes = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, [], 0

        def flush():
            nonlocal k, held, held_bytes
            chunk = part << 32 | k
            _save(f"{top}/{chunk}-{attempt}.texts", pa.Table.from_batches(held))
            row = pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([attempt], pa.int64()), pa.array([held_bytes], pa.int64())], ["chunk", "attempt", "bytes"])
            k, held, held_bytes = k + 1, [], 0
            return row

        for b in batches:
            at = 0
            sizes = np.cumsum(np.diff(np.frombuffer(K.texts(b.column("text")).buffers()[1], np.int64)[: b.num_rows + 1])) if b.num_rows else np.zeros(0)
            while at < b.num_rows:
                done = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES - held_bytes, "right")))
                held.append(b.slice(at, to - at))
                held_bytes += int(sizes[to - 1] - done)
                at = to
                if held_bytes >= CHUNK_BYTES:
                    yield flush()
        if held:
            yield flush()

    chunks = written(narrow.mapInArrow(stored, "chunk bigint, attempt bigint, bytes bigint"), "chunks")
    count, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(count, max(partitions, count // TASK_CHUNKS)))
    bits = min(30, max(8, (size // BUCKET_BYTES).bit_length(), (8 * partitions).bit_length()))  # several buckets a task, so that tasks are even
    shift = 64 - bits

    def first_pass(batches):
        group, chunks, keys = TaskContext.get().partitionId(), [], []
        for b in batches:
            for chunk, attempt in zip(b.column("chunk").to_pylist(), b.column("attempt").to_pylist(), strict=True):
                h, woff = _words(_load(f"{top}/{chunk}-{attempt}.texts").column("text"))
                chunks += [chunk, attempt]
                keys.append(np.unique(anchors(h, woff, window)[1]))
        if chunks:
            keys, count = np.unique(np.concatenate(keys), return_counts=True)
            yield _batch([_row(_home(group, bits), group, -1, np.array(chunks, np.int64).tobytes())])
            for several in (0, 1):
                some = keys[(count > 1) == several]
                yield _batch([_row(b, group, several, some[i:j].tobytes()) for b, i, j in _send(some, shift)])

    def repeated_anchors(batches):
        now, state = None, None
        for bucket, rows in _parts(batches, PART_BYTES):
            if bucket != now:
                now, state = bucket, AnchorBucket()
            sent = [r for r in rows if r[2] >= 0]
            n = [len(r[3]) // 8 for r in sent]
            key = np.frombuffer(b"".join(r[3] for r in sent), K.U64)
            told = state.take(key, np.repeat(np.array([r[1] for r in sent], np.int64), n), np.repeat(np.array([r[2] == 1 for r in sent], bool), n))
            yield _batch([*[r for r in rows if r[2] < 0], *_answers(bucket, *told)])

    def second_pass(batches):
        for _, rows in _by_chunk(batches):
            far = np.sort(np.frombuffer(b"".join(r[3] for r in rows if r[2] >= 0), K.U64))
            chunks = np.frombuffer(b"".join(r[3] for r in rows if r[2] < 0), np.int64).reshape(-1, 2)
            for chunk, attempt in chunks.tolist():
                table = _load(f"{top}/{chunk}-{attempt}.texts")
                h, woff = _words(table.column("text"))
                first, key = anchors(h, woff, window)
                _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                known = far[np.minimum(np.searchsorted(far, key), len(far) - 1)] == key if len(far) else np.zeros(len(key), bool)
                start = extended(first[known | (count[inverse] > 1)], woff, window)
                h1, h2 = K.window_hash(h, start, window, 72), K.window_hash(h, start, window, 73) >> K.U64(32)
                doc = np.searchsorted(woff, start, "right") - 1
                ids = table.column("id").combine_chunks().fill_null(LAST).to_numpy()
                order = np.lexsort((start, ids[doc], h2, h1))
                new = np.ones(len(order), bool)
                new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                mine, lost = order[new], order[~new]
                _save(f"{top}/{chunk}-{attempt}.windows", pa.table({"first": pa.array([start[mine].astype(np.int32), np.sort(start[lost]).astype(np.int32)], pa.list_(pa.int32()))}))
                k1, k2, own = h1[mine], h2[mine].astype(np.uint32), ids[doc[mine]]
                yield _batch([_row(_home(chunk, bits), chunk, -1, np.array([attempt], np.int64).tobytes()), *[_row(b, chunk, i, k1[i:j].tobytes() + k2[i:j].tobytes() + _planes(own[i:j])) for b, i, j in _send(k1, shift)]])

    def later_windows(batches):
        now, state = None, None
        for bucket, rows in _parts(batches, PART_BYTES):
            if bucket != now:
                now, state = bucket, WindowBucket()
            lost = []
            if sent := [r for r in rows if r[2] >= 0]:
                n = [len(r[3]) // 20 for r in sent]
                k1 = np.concatenate([np.frombuffer(r[3], K.U64, m) for r, m in zip(sent, n, strict=True)])
                k2 = np.concatenate([np.frombuffer(r[3], np.uint32, m, 8 * m) for r, m in zip(sent, n, strict=True)])
                own = np.concatenate([np.ascontiguousarray(np.frombuffer(r[3], np.uint8, 8 * m, 12 * m).reshape(8, m).T).view("<i8").ravel() for r, m in zip(sent, n, strict=True)])
                index = np.concatenate([np.arange(r[2], r[2] + m) for r, m in zip(sent, n, strict=True)])
                chunk, index = state.take(k1, k2, own, np.repeat(np.array([r[1] for r in sent], np.int64), n), index)
                lost = _answers(bucket, chunk, index.astype(np.uint32))
            yield _batch([*[r for r in rows if r[2] < 0], *lost])

    fields = [*names, *made]

    def third_pass(batches):
        for chunk, rows in _by_chunk(batches):
            attempt = int(np.frombuffer(next(r[3] for r in rows if r[2] < 0), np.int64)[0])
            table = _load(f"{top}/{chunk}-{attempt}.texts")
            mine, lost = _load(f"{top}/{chunk}-{attempt}.windows").column("first").to_pylist()
            far = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r[3], np.uint32) for r in rows if r[2] >= 0]])
            first = np.concatenate([np.array(lost, np.int64), np.array(mine, np.int64)[far]])
            text = K.texts(table.column("text"))
            n_words, n_gone, digest, kept = [], [], [], []
            seen = 0
            for _, n, data, at in K.slices(text):
                s, e, woff = K.split(data, at)
                here = first[(first >= seen) & (first < seen + len(s))] - seen
                gone = K.covered(here, window, len(s))
                seen += len(s)
                total = np.concatenate([[0], np.cumsum(gone)])[woff]
                raw = data.tobytes()
                for d in range(n):
                    a, b = int(woff[d]), int(woff[d + 1])
                    n_words.append(b - a)
                    n_gone.append(int(total[d + 1] - total[d]))
                    if not n_gone[-1]:
                        digest.append(hashlib.sha256(b" ".join(raw[at[d] : at[d + 1]].split())).hexdigest())
                        kept.append(None)
                        continue
                    left = np.flatnonzero(~gone[a:b]) + a
                    digest.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(s[left].tolist(), e[left].tolist(), strict=True)])).hexdigest())
                    if with_text:
                        until = np.append(s[a + 1 : b], at[d + 1])
                        kept.append(b"".join([raw[at[d] : s[a]], *[raw[i:j] for i, j in zip(s[left].tolist(), until[left - a].tolist(), strict=True)]]).decode())
            out = [*[table.column(c).combine_chunks() for c in names], pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                old = table.column("text").to_pylist()
                out.append(pa.array([t if k is None else k for t, k in zip(old, kept, strict=True)], pa.string()))
            yield from pa.Table.from_arrays(out, fields).to_batches(max_chunksize=2000)

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    # dealt out in a fixed order, so that a task that runs again has the same group
    one = by_bucket(chunks.select("chunk", "attempt").repartition(tasks).mapInArrow(first_pass, ROW)).mapInArrow(repeated_anchors, ROW)
    grouped = one.repartitionById(tasks, F.col("chunk").cast("int")).sortWithinPartitions("chunk")
    two = by_bucket(grouped.mapInArrow(second_pass, ROW)).mapInArrow(later_windows, ROW)
    schema = ", ".join([*[f"{n} {kinds[c]}" for n, c in zip(names, carry, strict=True)], "n_words bigint, n_removed bigint, kept_sha256 string", *["kept_text string"] * with_text])
    return two.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(third_pass, schema).toDF(*carry, *made)
