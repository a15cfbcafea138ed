"""WARC archives with a two-level capture index.

Records are gzip members of ``.warc.gz`` files. The index has one entry a record: its key (host labels reversed, then the
path), page id, file, offset, length and date. Entries are range-sorted by key; a task writes one index file: blocks of
``ENTRIES`` entries, each compressed by itself, and the sparse directory of the blocks' first keys at the file's end. The
driver holds the first key of each index file only. A lookup searches those by bisection, then a file's directory, then
one block, and reads the record by a range read of the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from contextlib import ExitStack

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import get, new_path, open_fs, put, streamed, written

ENTRIES = 1500
FILE_BYTES = 48 << 20
#: Bytes of an archive that are read at once, and that a task reads in all where there are more of them than tasks.
READ_BYTES, TASK_BYTES = 2 << 20, 128 << 20
LEAST_REVISIT = 100
NO_ID = -(1 << 63)
MAGIC = b"FPCX1\n"
#: Date of records whose rows have none.
DATE = "2020-01-01T00:00:00Z"
ENTRY = "key string, id bigint, file string, offset bigint, length bigint, date string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL = re.compile(r"(?s)^(.*?)://([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path and query; without ``://``, the whole string after an empty host."""
    if url is None:
        return ""
    m = URL.match(url)
    if not m:
        return ")" + url
    host, _, port = m[2].lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[3] or "/")


def _value(text: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One record, compressed by itself. A revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_value(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one compressed record; the payload of a revisit is empty. Raises where lengths or digests don't agree."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
        raise ValueError("broken record")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and (len(payload) != int(headers["WARC-Payload-Length"]) or "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]):
        raise ValueError("payload does not match its digest")
    return headers, payload


def entry_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "id", "file", "offset", "length", "date"])


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row; index entries key, id, file, offset, length, date.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest id are responses and the others
    revisit it; a group without ids has responses only. A null payload is empty, a null URL leaves its header out. Ids are
    whole numbers. ``date_col`` is a timestamp (UTC); a null one, or none, gives DATE. Rows stay apart, repeated ones too. A payload of any length is
    one record. Other columns are not read, whatever their names. An empty table gives no entries.
    """
    top = new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    date = F.date_format(F.col(f"`{date_col}`"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.coalesce(date, F.lit(DATE)).alias("date"))
    sized = rows.filter(F.octet_length("body") >= LEAST_REVISIT)
    groups = written(sized.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("d", "first"), "payloads")
    rows = rows.join(groups, F.col("digest") == F.col("d"), "left").select("id", "url", "body", "digest", "date", F.when(F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers"))

    def write(batches):
        part, attempt, k, size, name, out, open_file = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, 0, "", None, ExitStack()
        entries: list[tuple] = []

        def finished():
            nonlocal k, size, out, entries
            open_file.close()
            done, k, size, out, entries = entry_batch(entries), k + 1, 0, None, []
            return done

        with open_file:
            for b in batches:
                bodies = b.column("body").cast(pa.large_string()).cast(pa.large_binary())
                for i, url, digest, refers, date, body in zip(*[b.column(c).to_pylist() for c in ("id", "url", "digest", "refers", "date")], bodies, strict=True):
                    if out is None:
                        name = f"{top}/part-{part:06d}-{k:05d}-{attempt}.warc.gz"
                        out = open_file.enter_context(streamed(name))
                    raw = record(i, url, body.as_py(), digest, refers, refers is not None, date)
                    out.write(raw)
                    entries.append((url_key(url), i, name, size, len(raw), date))
                    size += len(raw)
                    if size >= file_bytes:
                        yield finished()
            if out is not None:
                yield finished()

    return written(rows.mapInArrow(write, ENTRY), "captures")


def write_index(entries: DataFrame, block: int = ENTRIES) -> list[tuple[str, int, str]]:
    """Sorts the entries into index files; (first key, first id, path) of each, ascending: one row a file."""
    top = new_path(entries.sparkSession, "index")

    def write(batches):
        part, attempt, zipper = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), zstandard.ZstdCompressor(level=3)
        rows, out, directory, at = [], [], [], 0

        def flush(n):
            nonlocal rows, at
            data = zipper.compress(json.dumps(rows[:n]).encode())
            directory.append([rows[0][0], rows[0][1], at, len(data)])
            out.append(data)
            at += len(data)
            rows = rows[n:]

        for b in batches:
            rows += [list(r) for r in zip(*[b.column(c).to_pylist() for c in ("key", "id", "file", "offset", "length", "date")], strict=True)]
            while len(rows) >= block:
                flush(block)
        if rows:
            flush(len(rows))
        if directory:
            foot = zipper.compress(json.dumps(directory).encode())
            path = f"{top}/part-{part:06d}-{attempt}.cdx"
            put(path, b"".join([*out, foot, struct.pack("<Q", len(foot)), MAGIC]))
            yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "id": [directory[0][1]], "path": [path]}, schema=pa.schema([("key", pa.string()), ("id", pa.int64()), ("path", pa.string())]))

    keyed = entries.withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    # file and offset too, so that entries without URL and id, which share a key, are cut into files like others
    ordered = keyed.repartitionByRange("key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "key string, id bigint, path string").collect())


class IndexFile:
    """An index file's directory, and its last block read."""

    def __init__(self, path: str):
        system, inner = open_fs(path)
        size = system.get_file_info(inner).size
        tail = get(path, size - 14, 14)
        if tail[8:] != MAGIC:
            raise ValueError(f"not an index file: {path}")
        n = struct.unpack("<Q", tail[:8])[0]
        self.path, self.unzip = path, zstandard.ZstdDecompressor()
        self.directory = json.loads(self.unzip.decompress(get(path, size - 14 - n, n), max_output_size=1 << 31))
        self.first = [(x[0], x[1]) for x in self.directory]
        self.at, self.rows, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.at:
            _, _, offset, length = self.directory[k]
            self.rows = json.loads(self.unzip.decompress(get(self.path, offset, length), max_output_size=1 << 31))
            self.keys, self.at = [(r[0], r[1]) for r in self.rows], k

    def find(self, low: tuple, high: tuple):
        """Entries from ``low`` to ``high`` inclusive, by bisection of the directory, then of a block."""
        k = max(0, bisect.bisect_left(self.first, low) - 1)
        while k < len(self.first) and self.first[k] <= high:
            self.block(k)
            i = bisect.bisect_left(self.keys, low)
            while i < len(self.keys) and self.keys[i] <= high:
                yield self.rows[i]
                i += 1
            k += 1


def lookup(index: list[tuple[str, int, str]], wanted: DataFrame) -> DataFrame:
    """Captures of keys: rows of ``wanted`` have key and id (null: all captures of the key). Gives key, id, file, offset, length, date.

    Each pair is searched for once, however often it is asked for. A task searches one index file, or a few. A null key, one that is not there and
    an empty table of either kind give no rows; captures that share key and id are all given.
    """
    spark = wanted.sparkSession
    top = spark.sparkContext.broadcast(index)
    firsts = [(k, i) for k, i, _ in index]
    shared = spark.sparkContext.broadcast(firsts)

    def files_of(batches):
        for b in batches:
            out = []
            for key, low, high in zip(b.column("key").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True):
                k = max(0, bisect.bisect_left(shared.value, (key, low)) - 1)
                while k < len(shared.value) and shared.value[k] <= (key, high):
                    out.append((k, key, low, high))
                    k += 1
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["file_no", "key", "low", "high"])

    def search(batches):
        now, opened = -1, None
        for b in batches:
            out = []
            for k, key, low, high in zip(*[b.column(c).to_pylist() for c in ("file_no", "key", "low", "high")], strict=True):
                if k != now:
                    now, opened = k, IndexFile(top.value[k][2])
                out += opened.find((key, low), (key, high))
            yield entry_batch([(key, None if i == NO_ID else i, *rest) for key, i, *rest in out])

    asked = wanted.filter("key is not null").select("key", F.coalesce("id", F.lit(NO_ID)).alias("low"), F.coalesce("id", F.lit(2**63 - 1)).alias("high")).distinct()
    found = asked.mapInArrow(files_of, "file_no int, key string, low bigint, high bigint")
    # index files are cut by range, so each has its share of the entries
    found = found.repartition(max(1, len(index)), "file_no").sortWithinPartitions("file_no", "key", "low")
    return found.mapInArrow(search, ENTRY)


def read_records(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the records at the entries, by range reads; entries next to one another share a read.

    An entry stands for far more bytes than it has, so the number of ``tasks`` is given (the session's shuffle partitions by default). A repeated
    entry gives its record again; no entries give no rows.
    """
    tasks = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for b in batches:
            rows = list(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
            out, i = [], 0
            while i < len(rows):
                j, (name, start, n) = i + 1, rows[i]
                end = start + n
                while j < len(rows) and rows[j][0] == name and start <= rows[j][1] <= end and end - start < READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                data = get(name, start, end - start)
                for _, offset, length in rows[i:j]:
                    h, _ = parse(data[offset - start : offset - start + length])
                    number = lambda x: None if x is None else int(x)
                    out.append((number(h.get("WARC-Page-ID")), h.get("WARC-Target-URI"), int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], number(h.get("WARC-Refers-To-Page-ID"))))
                i = j
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    near = entries.select("file", "offset", "length").withColumn("part", F.expr(f"offset div {READ_BYTES}"))
    near = near.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """key and id of every row; a null id stands for the entry without one."""

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("id").fill_null(NO_ID)], ["key", "id"])

    return pages.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{id_col}`").cast("bigint").alias("id")).mapInArrow(keys, "key string, id bigint")


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives all rows and reads every capture back through the index: a row for each row, repeated ones too.

    Nulls, equal payloads, very long ones, ties and columns of other names are as ``write_archive`` has them; of equal payloads with one
    smallest id all rows of that id are responses. An empty table gives no rows.
    """
    captures = write_archive(pages, id_col, url_col, payload_col)
    size = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    return read_records(lookup(write_index(captures), keys_of(pages, id_col, url_col)), tasks)
