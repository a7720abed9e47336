"""Event files by byte ranges, with filters at the source."""

import random
import struct

import numpy as np
from pyspark.sql import functions as F

from chatloom.sources import event_source, events


def framed(body):
    head = struct.pack("<Q", len(body))
    crc = lambda b: struct.pack("<I", int(event_source.checksums(np.frombuffer(b, np.uint8)[None, :])[0]))
    return head + crc(head) + body + crc(body)


def event(tag, step, value, pad=0):
    varint = lambda n: bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])
    field = lambda n, kind, raw: bytes([n << 3 | kind]) + (varint(len(raw)) if kind == 2 else b"") + raw
    body = field(2, 0, varint(step)) + field(5, 2, field(1, 2, field(1, 2, tag.encode()) + field(2, 5, struct.pack("<f", value))))
    return framed(body + field(3, 2, b"\0" * pad))


def test_ranges_and_filters(spark, tmp_path):
    rnd = random.Random(1)
    want = []
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        raw = b""
        for step in range(600):
            tag, value = rnd.choice(["loss", "lr"]), rnd.randint(0, 100) / 4
            raw += event(tag, step, value, rnd.choice([0, 0, 0, 5, 3000]))
            want.append((run, tag, step, value))
        (tmp_path / run / "events.out.1").write_bytes(raw + b"\x09\0\0\0\0\0\0\0torn")
    (tmp_path / "b" / "other.txt").write_bytes(b"x")
    rows = event_source.event_scalars(spark, str(tmp_path), 5000)
    plain = lambda df: sorted((r.run, r.tag, r.step, r.value) for r in df.collect())
    assert rows.rdd.getNumPartitions() > 50
    assert plain(rows) == sorted(want) == plain(events.read_scalars(spark, str(tmp_path)))
    some = rows.where((F.col("run") == "b") & (F.col("tag") == "loss") & (F.col("step") > 500) & (F.col("value") < 10))
    assert plain(some) == sorted(w for w in want if w[0] == "b" and w[1] == "loss" and w[2] > 500 and w[3] < 10)
    assert some.rdd.getNumPartitions() < rows.rdd.getNumPartitions() * 0.7  # the other run's file isn't opened
    assert plain(rows.where(F.col("tag").isin("lr", "none"))) == sorted(w for w in want if w[1] == "lr")
    assert plain(event_source.event_scalars(spark, f"file://{tmp_path}")) == sorted(want)


def test_checksum():
    """The known check value of CRC-32C, unmasked."""
    masked = int(event_source.checksums(np.frombuffer(b"123456789", np.uint8)[None, :])[0])
    rotated = (masked - 0xA282EAD8) & 0xFFFFFFFF
    assert (rotated >> 17 | rotated << 15) & 0xFFFFFFFF == 0xE3069283
