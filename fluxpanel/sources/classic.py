"""Grids in files of the classic NetCDF layout (CDF-1, CDF-2 and CDF-5), read and written by Spark's tasks without a library for them.

    spark.dataSource.register(ClassicSource)
    spark.read.format("netcdf_classic").option("variable", "sm").load("folder or pattern")
    rows.repartition("year").sortWithinPartitions("ts", "lat", "lon").write.format("netcdf_classic").option("variable", "sm")....save("folder")

Reading: one row a cell and time: lat, lon, ts and value, fill values and NaN as NULL. Files are listed, not opened, on the driver; each is read in as many
tasks as its bytes ask for, and a task parses the header and reads ranges of bytes. Filters on ts skip files by the year in their names (``year`` is a
pattern with one group) and times within a file; filters on lat skip rows of the grid. With ``spark.sql.python.filterPushdown.enabled``.

Writing: one file a year, with a slab for every day of the year that lies between ``first`` and ``last``, on the grid of ``south``, ``west``, ``step``,
``rows`` and ``cols`` (cell centres). Rows must come by year and in order of time; a task holds one slab. Files are written under names of their own and
take their places when all tasks are done; a task or job that fails leaves none.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format: tags, and the types by number.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
UNITS = {"days": 86400.0, "day": 86400.0, "hours": 3600.0, "hour": 3600.0, "minutes": 60.0, "minute": 60.0, "seconds": 1.0, "second": 1.0}
FILL = float(np.float32(9.969209968386869e36))

#: Bytes of a file that a task reads, bytes of a batch, bytes that are read for a header at first.
SPLIT, BATCH, HEADER = 64 << 20, 16 << 20, 1 << 16
EPOCH = dt.datetime(1970, 1, 1)


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Short(Exception):
    """The header is longer than what was read of it."""


@dataclass
class Variable:
    dims: list[int]
    attrs: dict
    kind: np.dtype
    begin: int
    #: bytes of one record, or of all of it
    size: int = 0
    record: bool = False


@dataclass
class Header:
    lengths: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    records: int = 0
    stride: int = 0


class Parser:
    """A cursor over a header's bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a file of the classic NetCDF layout")
        self.at, self.wide, self.far = 4, raw[3] == 5, raw[3] != 1

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise Short
        self.at += n
        return self.raw[self.at - n : self.at]

    def tag(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q" if self.wide else ">i", self.take(8 if self.wide else 4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode("utf-8")

    def attributes(self) -> dict:
        self.tag()
        out = {}
        for _ in range(self.count()):
            name, kind = self.name(), TYPES[self.tag()]
            n = self.count()
            raw = self.padded(n * np.dtype(kind).itemsize)
            out[name] = raw.decode("utf-8").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)
        return out

    def header(self, size: int) -> Header:
        """The whole header; ``size`` is the file's, for files that don't say how many records they have."""
        out = Header(records=self.count())
        self.tag()
        for _ in range(self.count()):
            out.names.append(self.name())
            out.lengths.append(self.count())
        out.attrs = self.attributes()
        self.tag()
        for _ in range(self.count()):
            name = self.name()
            dims = [self.count() for _ in range(self.count())]
            attrs, kind = self.attributes(), np.dtype(TYPES[self.tag()])
            self.count()
            begin = struct.unpack(">q" if self.far else ">i", self.take(8 if self.far else 4))[0]
            record = bool(dims) and out.lengths[dims[0]] == 0
            n = int(np.prod([out.lengths[d] for d in dims[record:]], dtype=np.int64)) * kind.itemsize
            out.variables[name] = Variable(dims, attrs, kind, begin, n, record)
        held = [v for v in out.variables.values() if v.record]
        out.stride = held[0].size if len(held) == 1 else sum(v.size + -v.size % 4 for v in held)
        if out.records < 0 and held:
            out.records = max(size - min(v.begin for v in held), 0) // max(out.stride, 1)
        return out


def read_header(source, size: int) -> Header:
    want = HEADER
    while True:
        source.seek(0)
        raw = source.read(min(want, size))
        try:
            return Parser(raw).header(size)
        except Short:
            if want >= size:
                raise ValueError("the file ends within its header") from None
            want *= 4


def values(source, header: Header, name: str) -> np.ndarray:
    """All of a small variable of one dimension."""
    v = header.variables[name]
    if not v.record:
        source.seek(v.begin)
        return np.frombuffer(source.read(v.size), v.kind).astype(float)
    out = []
    for r in range(header.records):
        source.seek(v.begin + r * header.stride)
        out.append(np.frombuffer(source.read(v.size), v.kind).astype(float))
    return np.concatenate(out) if out else np.zeros(0)


def times(numbers: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Times as microseconds since 1970 from numbers and their units (days since ...)."""
    if calendar.lower() not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {calendar}")
    unit, _, since = units.partition(" since ")
    since = dt.datetime.fromisoformat(re.sub(r"\b(\d)\b", r"0\1", since.strip().removesuffix("UTC").strip()).replace("T", " "))
    return np.round(numbers * UNITS[unit.strip().lower()] * 1e6).astype(np.int64) + round((since.replace(tzinfo=None) - EPOCH).total_seconds() * 1e6)


def decoded(raw: bytes, v: Variable) -> np.ndarray:
    """A variable's numbers with scale and offset, NaN for fill values."""
    out = np.frombuffer(raw, v.kind).astype(float)
    for name in ("_FillValue", "missing_value"):
        if name in v.attrs:
            out[out == float(v.attrs[name][0])] = np.nan
    if "_FillValue" not in v.attrs and v.kind.kind == "f":
        out[np.abs(out) >= FILL * 0.999] = np.nan
    if "scale_factor" in v.attrs:
        out = out * float(v.attrs["scale_factor"][0])
    return out + float(v.attrs["add_offset"][0]) if "add_offset" in v.attrs else out


class ClassicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def schema(self) -> str:
        return "lat double, lon double, ts timestamp_ntz, value double"

    def reader(self, schema):
        return ClassicReader(dict(self.options))

    def writer(self, schema, overwrite):
        return ClassicWriter(dict(self.options), overwrite)


class Part(InputPartition):
    """The ``index``-th of ``total`` parts of a file."""

    def __init__(self, uri: str, size: int, index: int, total: int):
        self.uri, self.size, self.index, self.total = uri, size, index, total


class ClassicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options["variable"]
        self.names = [options.get(n, n) for n in ("lat", "lon", "time")]
        self.year, self.split = options.get("year", r"(\d{4})\.nc$"), int(options.get("split", SPLIT))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def pushFilters(self, filters):
        """Bounds on ts and lat, kept as inclusive ones; Spark applies all filters once more."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("ts", "lat"):
                value = getattr(f, "value", None)
                x = round((value.replace(tzinfo=None) - EPOCH).total_seconds() * 1e6) if isinstance(value, dt.datetime) else value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[column] = max(self.low.get(column, x), x)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[column] = min(self.high.get(column, x), x)
            yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files that the path names and the filters leave, by one listing of their folder."""
        from pyarrow import fs

        folder, _, last = self.path.rstrip("/").rpartition("/")
        pattern = last if any(c in last for c in "*?[") else None
        system, at = open_fs(folder if pattern else self.path.rstrip("/"))
        info = system.get_file_info(at)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at))
        out = []
        for f in found:
            if not f.is_file or f.base_name.startswith(("_", ".")) or (pattern and not fnmatch.fnmatch(f.base_name, pattern)):
                continue
            year = re.search(self.year, f.base_name)
            if year:
                begin, end = (round((dt.datetime(int(year[1]) + k, 1, 1) - EPOCH).total_seconds() * 1e6) for k in (0, 1))
                if self.low.get("ts", begin) >= end or self.high.get("ts", begin) < begin:
                    continue
            scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
            out.append((f"{scheme}{f.path}", f.size))
        if not found:
            raise FileNotFoundError(self.path)
        return sorted(out)

    def partitions(self):
        parts = []
        for uri, size in self.files():
            n = max(1, -(-size // self.split))
            parts += [Part(uri, size, i, n) for i in range(n)]
        return parts or [Part("", 0, 0, 1)]  # there has to be one

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        system, at = open_fs(partition.uri)
        with system.open_input_file(at) as source:
            header = read_header(source, partition.size)
            v, (lat, lon, time) = header.variables[self.variable], self.names
            order = [header.names[d] for d in v.dims]
            if order != [time, lat, lon]:
                raise ValueError(f"{partition.uri}: {self.variable} has the dimensions {order}, not {[time, lat, lon]}")
            lats, lons = values(source, header, lat), values(source, header, lon)
            axis = header.variables[time]
            when = times(values(source, header, time), axis.attrs["units"], axis.attrs.get("calendar", "standard"))
            rows = np.flatnonzero((lats >= self.low.get("lat", -np.inf)) & (lats <= self.high.get("lat", np.inf)))
            if not len(rows):
                return
            top, bottom = int(rows[0]), int(rows[-1]) + 1
            line = len(lons) * v.kind.itemsize
            step = header.stride if v.record else len(lats) * line
            for t in range(len(when) * partition.index // partition.total, len(when) * (partition.index + 1) // partition.total):
                if not self.low.get("ts", -np.inf) <= when[t] <= self.high.get("ts", np.inf):
                    continue
                for i in range(top, bottom, max(1, BATCH // max(line, 1))):
                    j = min(bottom, i + max(1, BATCH // max(line, 1)))
                    source.seek(v.begin + t * step + i * line)
                    cells = decoded(source.read((j - i) * line), v)
                    stamp = pa.array(np.full(len(cells), when[t]), pa.int64()).cast(pa.timestamp("us"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lats[i:j], len(lons))), pa.array(np.tile(lons, j - i)), stamp, pa.array(cells, mask=np.isnan(cells))], ["lat", "lon", "ts", "value"])


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def attributes(attrs: dict) -> bytes:
    out = struct.pack(">ii", ATTRIBUTES if attrs else 0, len(attrs))
    for name, value in attrs.items():
        raw, kind, n = (value.encode(), 2, len(value.encode())) if isinstance(value, str) else (struct.pack(">f", value), 5, 1)
        out += struct.pack(">i", len(name)) + padded(name.encode()) + struct.pack(">ii", kind, n) + padded(raw)
    return out


def header_bytes(dims: dict[str, int], variables: dict[str, tuple[list[str], int, dict]], attrs: dict) -> bytes:
    """A CDF-2 header for variables (dimensions, type, attributes) that follow it in this order without records."""
    names = list(dims)
    out = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSIONS, len(dims))
    for name, n in dims.items():
        out += struct.pack(">i", len(name)) + padded(name.encode()) + struct.pack(">i", n)
    out += attributes(attrs) + struct.pack(">ii", VARIABLES, len(variables))
    heads, sizes = [], []
    for name, (of, kind, each) in variables.items():
        sizes.append(int(np.prod([dims[d] for d in of], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize)
        heads.append(struct.pack(">i", len(name)) + padded(name.encode()) + struct.pack(f">{len(of) + 1}i", len(of), *[names.index(d) for d in of]) + attributes(each) + struct.pack(">iI", kind, min(sizes[-1] + -sizes[-1] % 4, 0xFFFFFFFF)))
    begin = len(out) + sum(len(h) + 8 for h in heads)
    for h, n in zip(heads, sizes, strict=True):
        out += h + struct.pack(">q", begin)
        begin += n + -n % 4
    return out


@dataclass
class Done(WriterCommitMessage):
    #: (temporary name, final name) of each file
    files: list[tuple[str, str]]


class ClassicWriter(DataSourceArrowWriter):
    """Rows of ts (date or timestamp), lat, lon and value, by year and in order of time within a task."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.variable, self.overwrite = options["path"].rstrip("/"), options["variable"], overwrite
        self.south, self.west, self.step = (float(options[n]) for n in ("south", "west", "step"))
        self.rows, self.cols = int(options["rows"]), int(options["cols"])
        self.first, self.last = (dt.date.fromisoformat(options.get(n, d)) for n, d in (("first", "0001-01-01"), ("last", "9999-12-31")))
        self.units, self.title = options.get("units", "1"), options.get("title", self.variable)
        self.prefix, self.run = options.get("prefix", self.variable), uuid.uuid4().hex

    def begin(self, year: int) -> tuple[bytes, int, int]:
        """(header and axes, first day, number of days) of a year's file."""
        days = [max(self.first, dt.date(year, 1, 1)), min(self.last, dt.date(year, 12, 31))]
        low, n = (days[0] - EPOCH.date()).days, (days[1] - days[0]).days + 1
        dims = {"lat": self.rows, "lon": self.cols, "time": n}
        axes = {"lat": (["lat"], 6, {"units": "degrees_north"}), "lon": (["lon"], 6, {"units": "degrees_east"}), "time": (["time"], 4, {"units": "days since 1970-01-01 00:00:00", "calendar": "standard"})}
        main = {self.variable: (["time", "lat", "lon"], 5, {"_FillValue": FILL, "units": self.units, "long_name": self.title})}
        centres = lambda edge, k: (edge + self.step * (np.arange(k) + 0.5)).astype(">f8").tobytes()
        return header_bytes(dims, axes | main, {"title": self.title}) + centres(self.south, self.rows) + centres(self.west, self.cols) + np.arange(low, low + n).astype(">i4").tobytes(), low, n

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        system, root = open_fs(self.path)
        files, out, year, day, low, n = [], None, None, None, 0, 0
        empty = np.full(self.rows * self.cols, FILL, ">f4")
        slab = empty.copy()

        def finish_days(upto: int) -> None:
            """Writes the slab under way and empty ones up to a day."""
            nonlocal day, slab
            while day < upto:
                out.write(slab.tobytes())
                slab, day = empty.copy(), day + 1

        try:
            system.create_dir(f"{root}/_{self.run}", recursive=True)
            for b in iterator:
                if not b.num_rows:
                    continue
                days = b.column("ts").cast(pa.date32()).cast(pa.int32()).to_numpy(zero_copy_only=False)
                i = np.round((b.column("lat").to_numpy(zero_copy_only=False) - self.south) / self.step - 0.5).astype(np.int64)
                j = np.round((b.column("lon").to_numpy(zero_copy_only=False) - self.west) / self.step - 0.5).astype(np.int64)
                if ((i < 0) | (i >= self.rows) | (j < 0) | (j >= self.cols)).any():
                    raise ValueError("a row lies outside of the grid")
                x = b.column("value").cast(pa.float32()).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), b.num_rows]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    d = int(days[s])
                    y = (EPOCH + dt.timedelta(days=d)).year
                    if y != year:
                        if out:
                            finish_days(low + n)
                            out.close()
                        if any(f[1].endswith(f"_{y}.nc") for f in files):
                            raise ValueError("rows don't come by year and in order of time")
                        head, low, n = self.begin(y)
                        year, day, name = y, low, f"{self.prefix}_{y}.nc"
                        files.append((f"{root}/_{self.run}/{uuid.uuid4().hex}_{name}", f"{root}/{name}"))
                        out = system.open_output_stream(files[-1][0], compression=None)
                        out.write(head)
                    if not day <= d < low + n:
                        raise ValueError("rows don't come in order of time, or lie outside of the record")
                    finish_days(d)
                    part = x[s:e]
                    slab[i[s:e] * self.cols + j[s:e]] = np.where(np.isnan(part.astype(float)), FILL, part)
            if out:
                finish_days(low + n)
                out.close()
        except BaseException:
            if out:
                out.close()
            for f, _ in files:
                if system.get_file_info(f).is_file:
                    system.delete_file(f)
            raise
        return Done(files)

    def commit(self, messages) -> None:
        """All files take their places; with overwrite, years that are there already are replaced, else that is an error."""
        system, root = open_fs(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            self.abort(messages)
            raise ValueError(f"more than one task wrote {twice}; deal the rows by year")
        if not self.overwrite and (there := [n for n in names if system.get_file_info(n).is_file]):
            self.abort(messages)
            raise FileExistsError(there)
        for part, name in files:
            if system.get_file_info(name).is_file:
                system.delete_file(name)
            system.move(part, name)
        system.delete_dir(f"{root}/_{self.run}")

    def abort(self, messages) -> None:
        system, root = open_fs(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")
