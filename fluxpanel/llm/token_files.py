"""Token ids in binary files: blocks of ids, transposed into bit or byte planes, each plane compressed by itself.

A file: the planes of its blocks one after the other, then the compressed index (documents with their counts; blocks
with their number of ids and the length of each plane), then the index's length and the magic bytes. Files are written by
ascending document id, so their names' order is the order of all ids; a block is read by a range read of its planes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import before_each, get, new_path, streamed, written
from .tokens import encoder

BLOCK = 1 << 16
#: A file ends at so many bytes of planes, or so many documents, which bounds its index.
FILE_BYTES, FILE_DOCS = 48 << 20, 1 << 18
MAGIC = b"FPTB1\n"


def to_planes(ids: np.ndarray, width: int, kind: str) -> np.ndarray:
    """One row a plane: ``width`` byte planes, or 8 * width bit planes, from the lowest up."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return np.ascontiguousarray(raw.T)
    return np.concatenate([np.packbits((raw[:, b] >> np.uint8(k) & np.uint8(1))[None, :], axis=1, bitorder="little") for b in range(width) for k in range(8)])


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(planes):
        a = np.frombuffer(p, np.uint8)
        if kind == "byte":
            raw[:, i] = a
        else:
            raw[:, i // 8] |= np.unpackbits(a, count=n, bitorder="little") << np.uint8(i % 8)
    return raw.reshape(-1).view("<u4").astype(np.uint32)


class FileWriter:
    """Writes ids to one file; of the planes, those of the block at work alone are in memory."""

    def __init__(self, sink, kind: str = "bit", block: int = BLOCK, level: int = 3):
        self.sink, self.kind, self.block, self.zip = sink, kind, block, zstandard.ZstdCompressor(level=level)
        self.wait: list[np.ndarray] = []
        self.waiting, self.bytes, self.docs, self.counts, self.blocks = 0, 0, [], [], []

    def add(self, doc_ids: list[str | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += counts.tolist()
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._blocks(final=False)

    def _blocks(self, final: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        stop = len(ids) if final else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            part = ids[i : min(i + self.block, stop)]
            width = max(1, (int(part.max()).bit_length() + 7) // 8)
            planes = [self.zip.compress(p.tobytes()) for p in to_planes(part, width, self.kind)]
            self.blocks.append([len(part), width, *map(len, planes)])
            for p in planes:
                self.sink.write(p)
                self.bytes += len(p)
        self.wait, self.waiting = [ids[stop:].copy()], len(ids) - stop

    def finish(self) -> None:
        """Writes the rest and the index."""
        self._blocks(final=True)
        index = self.zip.compress(json.dumps({"kind": self.kind, "docs": self.docs, "counts": self.counts, "blocks": self.blocks}).encode())
        self.sink.write(b"".join([index, struct.pack("<Q", len(index)), MAGIC]))


def read_index(uri: str) -> dict:
    """A file's index, by two range reads from its end."""
    from .shared import open_fs

    system, path = open_fs(uri)
    size = system.get_file_info(path).size
    tail = get(uri, size - 14, 14)
    if tail[8:] != MAGIC:
        raise ValueError(f"not a token file: {uri}")
    n = struct.unpack("<Q", tail[:8])[0]
    index = json.loads(zstandard.ZstdDecompressor().decompress(get(uri, size - 14 - n, n), max_output_size=1 << 31))
    at = 0
    for b in index["blocks"]:
        b.append(at)
        at += sum(b[2:-1])
    return index


def read_block(uri: str, index: dict, k: int) -> np.ndarray:
    """The ids of block k."""
    n, width, *lengths, at = index["blocks"][k]
    data, unzip, planes, i = get(uri, at, sum(lengths)), zstandard.ZstdDecompressor(), [], 0
    for m in lengths:
        planes.append(unzip.decompress(data[i : i + m], max_output_size=4 * n + 64))
        i += m
    return from_planes(planes, n, width, index["kind"])


def read_documents(uri: str) -> Iterator[tuple[str | None, np.ndarray]]:
    """(document id as a string, ids) in the file's order, one block, or those of one document, in memory at a time."""
    index = read_index(uri)
    rest, k = np.zeros(0, np.uint32), 0
    for doc, n in zip(index["docs"], index["counts"], strict=True):
        if len(rest) < n:
            more = [rest]
            have = len(rest)
            while have < n:
                more.append(read_block(uri, index, k))
                have += len(more[-1])
                k += 1
            rest = np.concatenate(more)
        yield doc, rest[:n]
        rest = rest[n:]


def packed(ids: np.ndarray) -> bytes:
    """Ids in as few bytes each as the largest needs (2 or 4), after a byte with that number."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end: int | None = 2, planes: str = "bit", id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encodes and writes all documents by ascending id; one row a file: file_no, path, docs, first (ids before it), ids.

    Texts are encoded where they are read; only their ids are sorted. A null or empty text has the end id alone; null ids come
    first. Rows that share an id are ordered by a hash of their text, equal rows by the place they are read from: each has
    its own entry, and any number of them can be split. Ids are of any type that a cast to string and back keeps. Columns
    other than the two named are not read, whatever their names. A text of any length is encoded whole; it may fill many
    blocks of one file. An empty table gives no files. A lost task writes its files anew under other names, and only the
    names of finished tasks are in the table.
    """
    spark = docs.sparkSession
    top = new_path(spark, "tokens")
    id_type = dict(docs.dtypes)[id_col]

    def encode(batches):
        enc = encoder(tokenizer, kind)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                ids, counts = enc.encode(c.column("text"), end)
                edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
                yield pa.RecordBatch.from_arrays([c.column("id"), c.column("tie"), pa.array([packed(ids[x:y]) for x, y in zip(edge, edge[1:], strict=False)], pa.binary())], ["id", "tie", "ids"])

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        seq, path, out, open_file, step = 0, "", None, ExitStack(), min(256, file_docs)

        def finished():
            nonlocal seq, out
            out.finish()
            open_file.close()
            row, seq, out = [part, seq, path, len(out.docs), sum(out.counts)], seq + 1, None
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "docs", "ids"])

        with open_file:
            for b in batches:
                for i in range(0, b.num_rows, step):
                    if out is None:
                        path = f"{top}/part-{part:06d}-{seq:05d}-{attempt}.fptb"
                        out = FileWriter(open_file.enter_context(streamed(path)), planes)
                    c = b.slice(i, step)
                    ids = [unpacked(x.as_py()) for x in c.column("ids")]
                    out.add(c.column("id").to_pylist(), np.concatenate(ids), np.array([len(x) for x in ids], np.int64))
                    if out.bytes >= file_bytes or len(out.docs) >= file_docs:
                        yield finished()
            if out is not None:
                yield finished()

    table = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").alias("text"))
    table = written(table.mapInArrow(encode, f"id {id_type}, tie bigint, ids binary"), "encoded").withColumn("row", F.monotonically_increasing_id())
    ordered = table.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select(F.col("id").cast("string").alias("id"), "ids")
    files = written(ordered.mapInArrow(write, "part int, seq int, path string, docs bigint, ids bigint"), "files")
    files = files.withColumn("file_no", F.col("part").cast("bigint") * F.lit(1 << 20) + F.col("seq"))
    return before_each(files, "file_no", "ids", "first").select("file_no", "path", "docs", "first", "ids")


def read_token_files(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; a task for each file. No files give no rows."""
    n = max(1, files.count())

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                cols, at = ([], [], [], []), r["first"]
                for doc, ids in read_documents(r["path"]):
                    for c, v in zip(cols, (doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("file_no", "path", "first").repartitionByRange(n, "file_no").mapInArrow(read, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.withColumn("doc_id", F.col("doc_id").cast(id_type))
