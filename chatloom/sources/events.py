"""Scalar series out of training event files (record-framed protocol buffers), without other libraries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(raw: bytes) -> Iterator[bytes]:
    """Bodies of the records of a file: an 8-byte length, its checksum, the body, its checksum. A torn tail ends it."""
    at = 0
    while at + 12 <= len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        if at + 16 + n > len(raw):
            return
        yield raw[at + 12 : at + 12 + n]
        at += 16 + n


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; fixed and length-delimited ones as bytes."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        else:
            if kind == 2:
                size, at = varint(raw, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


STEP, SUMMARY, VALUE, TAG, SIMPLE = 2, 5, 1, 1, 2


def values_of(body: bytes) -> Iterator[tuple[str, int, float]]:
    """tag, step, value of each simple value of a record."""
    event = list(fields(body))
    step = next((v for k, v in event if k == STEP), 0)
    for _, summary in (f for f in event if f[0] == SUMMARY):
        for _, value in (f for f in fields(summary) if f[0] == VALUE):
            got = dict(fields(value))
            if TAG in got and SIMPLE in got:
                yield got[TAG].decode(), step, struct.unpack("<f", got[SIMPLE])[0]


def scalars_of(raw: bytes) -> Iterator[tuple[str, int, float]]:
    """tag, step, value of each simple value."""
    for body in records(raw):
        yield from values_of(body)


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """run (the folder), tag, step, value, file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name = b.column(0)[i].as_py()
                rows = list(scalars_of(b.column(1)[i].as_py()))
                if rows:
                    tag, step, value = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 2)[-2]] * len(rows)), pa.array(tag), pa.array(step, pa.int64()), pa.array(value, pa.float64()), pa.array([name] * len(rows))], ["run", "tag", "step", "value", "file"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "events.out.*").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "run string, tag string, step long, value double, file string")


def log_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders named ``logs`` that hold event files, and the folder each belongs to; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "events.out.*").option("recursiveFileLookup", True).load(path)
    found = files.select(F.regexp_extract("path", r"^(.*/([^/]+)/logs)/[^/]+$", 1).alias("logs"), F.regexp_extract("path", r"^(.*/([^/]+)/logs)/[^/]+$", 2).alias("name"))
    return found.where("logs <> ''").distinct()
