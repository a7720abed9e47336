"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A document's id has a place on the ring, and goes clockwise to the first virtual node. A
shard is full once it holds (1 + SPARE) of an even share of the bytes; documents that come
later go on clockwise to the next shard that isn't. Documents come in an order of their
own, the same in every run: large ones first, so that what fills a shard at the end is
small, and within a class of sizes by a hash of id and text. An added shard takes the
places before its own nodes, and little else moves.

When each shard gets full follows from the bytes by stretch of the ring and by bucket of
the order alone: shards times NODES stretches, and 2 ** BITS[0] buckets of each of some 12
classes of sizes, whatever the input. Only buckets in which a shard gets full are looked
into more finely.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import materialize

SHARDS = 24
#: Virtual nodes of a shard, and places on the ring.
NODES, PLACES = 128, 1 << 16
#: How much over an even share of what is left a shard takes before it is full.
SPARE = 0.0005
#: Bits of the order within a class of sizes, coarse to fine: buckets, their parts, and parts of those.
BITS = (3, 8, 8)
#: A bucket that overfills a shard by less than this share isn't looked into.
CLOSE = 0.0005


def nodes(shards: int) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in order, and their shards. A place taken by a smaller shard stays that shard's."""
    ring: dict[int, int] = {}
    for shard in range(shards):
        for node in range(NODES):
            ring.setdefault(int(hashlib.md5(f"{shard}/{node}".encode()).hexdigest()[:8], 16) % PLACES, shard)
    places = sorted(ring)
    return places, [ring[p] for p in places]


def owners(shard_of: list[int], full: set[int]) -> list[int]:
    """For each stretch of the ring, the first shard clockwise that isn't full."""
    out, now = [0] * len(shard_of), next(s for s in shard_of if s not in full)
    for i in reversed(range(len(shard_of))):
        now = now if shard_of[i] in full else shard_of[i]
        out[i] = now
    return out


def literals(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    """pos, ``name``: a table of numbers that the driver has."""
    text = F.lit(",".join(map(str, values)))
    return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("pos", name)).withColumn(name, F.col(name).cast("int"))


def measure(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, and where (stretch) and when (turn) each row comes to the ring; row numbers them.

    Written to the shared folder, without texts. A null text is empty, a null id is a place
    like any other; rows of one id come at different times, so they overflow like others.
    """
    places, _ = nodes(shards)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).cast("int").alias("_place"), F.monotonically_increasing_id().alias("row"),
    )
    ends = literals(docs.sparkSession, [bisect_left(places, p) % len(places) for p in range(PLACES)], "stretch")
    h = F.xxhash64("doc_id", "text_crc32", F.lit("turn"))
    early = F.pmod(h, F.lit(1 << sum(BITS[:2])))
    late = F.pmod(F.xxhash64(h, F.col("row")), F.lit(1 << BITS[2]))
    smaller = 63 - F.floor((F.length(F.bin("size")) - 1) / 2)
    turn = (smaller * (1 << sum(BITS)) + early * (1 << BITS[2]) + late).cast("long")
    joined = rows.join(F.broadcast(ends), F.col("_place") == F.col("pos"))
    return materialize(joined.select("doc_id", "size", "text_crc32", "stretch", turn.alias("turn"), "row"), "ring")


@dataclass
class Plan:
    """owner[e][stretch] is the shard of what comes between the turns starts[e - 1] and starts[e]."""

    owner: list[list[int]]
    starts: list[int] = field(default_factory=list)


def fill(measured: DataFrame, shards: int = SHARDS) -> Plan:
    """When each shard gets full, found from sums; rows of ``measure`` with the same ``shards``.

    A full shard's bytes are taken from what the others share, so that one with a document
    larger than a fair share leaves the rest even. The first sums are by stretch, one table
    for the whole run; those within a bucket are by shard, made anew when one gets full.
    """
    _, shard_of = nodes(shards)
    total = measured.agg(F.sum("size")).first()[0] or 0
    plan = Plan([owners(shard_of, set())])
    load, full = [0] * shards, set()

    def capacity() -> float:
        return (1 + SPARE) * (total - sum(load[s] for s in full)) / (shards - len(full))

    def pour(level: int, buckets: list[tuple[int, dict[int, int], int]], by_stretch: bool) -> int | None:
        """Add buckets to the shards; the number of the one in which some got full, if what comes after has to be summed anew."""
        shift = sum(BITS[level + 1 :])
        for b, sizes, n in buckets:
            after = load.copy()
            for at, size in sizes.items():
                after[plan.owner[-1][at] if by_stretch else at] += size
            most = capacity()
            over = [s for s in range(shards) if s not in full and after[s] >= most]
            if over and n > 1 and level + 1 < len(BITS) and max(after[s] for s in over) > (1 + CLOSE) * most:
                at: int | None = (b << BITS[level + 1]) - 1
                while at is not None:
                    at = pour(level + 1, within(level + 1, b, at), False)
            else:
                load[:] = after
                while over:
                    full.update(over)
                    over = [s for s in range(shards) if s not in full and load[s] >= capacity()]
                    if not over:
                        plan.starts.append((b + 1) << shift)
                        plan.owner.append(owners(shard_of, full))
                        if not by_stretch:
                            return b
        return None

    def listed(sums: DataFrame) -> list[tuple[int, dict[int, int], int]]:
        found: dict[int, dict[int, int]] = {}
        rows: dict[int, int] = {}
        for b, at, size, n in sums.collect():
            found.setdefault(b, {})[at] = size
            rows[b] = rows.get(b, 0) + n
        return [(b, found[b], rows[b]) for b in sorted(found)]

    def within(level: int, bucket: int, after: int) -> list[tuple[int, dict[int, int], int]]:
        """Parts of a bucket of the level above that come after the part ``after``, by shard as things are."""
        shift = sum(BITS[level + 1 :])
        part = measured.where(F.col("turn").between((after + 1) << shift, ((bucket + 1) << shift + BITS[level]) - 1))
        owner = literals(measured.sparkSession, plan.owner[-1], "owner")
        joined = part.join(F.broadcast(owner), F.col("stretch") == F.col("pos"))
        return listed(joined.groupBy(F.shiftright("turn", shift).alias("b"), "owner").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))

    if total:
        coarse = measured.groupBy(F.shiftright("turn", sum(BITS[1:])).alias("b"), "stretch").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        pour(0, listed(coarse), True)
    return plan


def place(measured: DataFrame, plan: Plan) -> DataFrame:
    """measured with its shard: a lookup in as many owners of stretches as shards got full, at most."""
    width = len(plan.owner[0])
    epoch: Column = F.lit(0)
    for start in plan.starts:
        epoch = epoch + (F.col("turn") >= start).cast("int")
    table = literals(measured.sparkSession, [s for owner in plan.owner for s in owner], "shard")
    return measured.withColumn("_at", epoch * width + F.col("stretch")).join(F.broadcast(table), F.col("_at") == F.col("pos")).drop("_at", "pos")


def slots(placed: DataFrame) -> DataFrame:
    """slot: gapless from 0 within each shard, in order of ``row``.

    Rows are numbered within the input partition they are from, which is in a row's upper
    bits, and start at the count of the shard's rows in earlier ones; no shard's rows meet
    in one task.
    """
    placed = placed.withColumn("_part", F.shiftright("row", 33))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("row")) - 1
    return placed.withColumn("_own", own).join(starts, ["shard", "_part"]).withColumn("slot", (F.col("_start") + F.col("_own")).cast("long")).drop("_own", "_start", "_part")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs: doc_id, text -> doc_id, size, text_crc32, shard, slot, a row for each row.

    Sizes are bytes of UTF-8 and 8 more. A shard is over (1 + SPARE) of an even share by no
    more than what fills it, a document or a part of a bucket within CLOSE; the last
    ones to fill are under it by a few times SPARE. Repeated rows are placed one by one, an
    empty table gives none, other columns are ignored.
    """
    measured = measure(docs.select("doc_id", "text"), shards)
    return slots(place(measured, fill(measured, shards))).select("doc_id", "size", "text_crc32", "shard", "slot")
