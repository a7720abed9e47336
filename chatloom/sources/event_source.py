"""Training event files as a source of Spark's own: ``spark.read.format("event_scalars").load(folder)``.

A file is read in byte ranges by as many tasks. A record begins with its length and a
checksum of that, so a task finds the first record of its range by looking for eight bytes
whose checksum follows them; a record belongs to the range where it begins. Filters on run
and file leave out files before they are opened, those on tag and step leave out values
as they are read.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from chatloom.sources.events import values_of

SCHEMA = "run string, tag string, step long, value double, file string"
#: Bytes of a range, and those that are looked through at once for its first record.
RANGE, LOOK = 64 << 20, 1 << 20
HEADER = 12


@functools.cache
def _table() -> np.ndarray:
    """CRC-32C of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0x82F63B78), out >> 1).astype(np.uint32)
    return out


def checksums(rows: np.ndarray) -> np.ndarray:
    """The masked CRC-32C that event files have, of rows of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = _table()[(crc ^ rows[:, k]) & 0xFF] ^ crc >> np.uint32(8)
    crc = ~crc
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def first_record(raw: bytes) -> int | None:
    """Where the first header stands whole in ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < HEADER:
        return None
    seen = np.lib.stride_tricks.sliding_window_view(data, HEADER)
    at = np.flatnonzero((seen[:, 5:8] == 0).all(1))  # no record has a terabyte
    hit = at[checksums(seen[at, :8]) == np.ascontiguousarray(seen[at, 8:12]).view("<u4")[:, 0]] if len(at) else at
    return int(hit[0]) if len(hit) else None


@dataclass
class ByteRange(D.InputPartition):
    path: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_under(path: str) -> list[tuple[str, int]]:
    """The event files in a folder and their sizes."""
    where, root = file_system(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.startswith("events.out."))


COMPARED = {D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b}


class EventReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.tests: list[tuple[str, D.Filter]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Takes comparisons of run, file, tag and step with values; gives back the others."""
        for f in filters:
            if isinstance(f, (D.EqualTo, D.In, *COMPARED)) and f.attribute[0] in ("run", "file", "tag", "step"):
                self.tests.append((f.attribute[0], f))
            else:
                yield f

    def passes(self, **values: object) -> bool:
        def one(value: object, f: D.Filter) -> bool:
            if isinstance(f, D.EqualTo):
                return value == f.value
            return value in f.value if isinstance(f, D.In) else COMPARED[type(f)](value, f.value)

        return all(one(values[name], f) for name, f in self.tests if name in values)

    def partitions(self) -> list[ByteRange]:
        kept = [(p, n) for p, n in files_under(self.path) if self.passes(run=p.rsplit("/", 2)[-2], file=p)]
        return [ByteRange(p, at, min(at + self.size, n)) for p, n in kept for at in range(0, n, self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.path)
        run, rows = partition.path.rsplit("/", 2)[-2], []
        with where.open_input_file(partition.path) as f:
            for body in bodies(f, partition.start, partition.stop):
                rows += [(tag, step, value) for tag, step, value in values_of(body) if self.passes(tag=tag, step=step)]
                if len(rows) >= 10_000:
                    yield batch(run, partition.path, rows)
                    rows = []
        if rows:
            yield batch(run, partition.path, rows)


def batch(run: str, path: str, rows: list[tuple[str, int, float]]) -> pa.RecordBatch:
    tag, step, value = map(list, zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([run] * len(rows)), pa.array(tag), pa.array(step, pa.int64()), pa.array(value, pa.float64()), pa.array([path] * len(rows))], ["run", "tag", "step", "value", "file"])


def bodies(f: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The records that begin within a range; a torn one ends the file."""
    at = start
    if start:
        at = None
        for look in range(start, stop, LOOK):
            raw = f.read_at(min(LOOK, stop - look) + HEADER - 1, look)
            if (hit := first_record(raw)) is not None:
                at = look + hit
                break
    while at is not None and at < stop:
        head = f.read_at(HEADER, at)
        if len(head) < HEADER:
            return
        (n,) = struct.unpack_from("<Q", head)
        body = f.read_at(n + 4, at + HEADER)
        if len(body) < n + 4:
            return
        yield body[:n]
        at += HEADER + n + 4


class EventSource(D.DataSource):
    """Options: path, and rangeBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "event_scalars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> EventReader:
        return EventReader(self.options)


def event_scalars(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """run, tag, step, value, file of the event files in a folder, with filters pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventSource)
    return spark.read.format("event_scalars").option("rangeBytes", range_bytes).load(path)
