"""A stored set of keys, so that a batch finds out what came before it without reading all of that.

Keys are dealt to buckets by the upper bits of a hash. A bucket has the keys that each
batch brought, in files of their own, and a Bloom filter of all of them in slices of 32,768
bits. A batch reads the filters of the buckets that it has keys for, and the keys only of
buckets whose filter says that one of its keys may be there.

    <path>/keys/n=<number>/bucket=<b>      what a batch brought
    <path>/filters/n=<number>/bucket=<b>   the whole bucket's filter as of a batch
    <path>/commits/<number>-<label>        for each bucket, which of these count

A commit is written last and as a whole, so a batch that broke off left nothing that counts,
and one that runs again under its label is found done. One writer at a time.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.tables import materialize

#: Bits of a slice of a filter (what bitmap_construct_agg makes), and bits that a key sets in it.
SLICE, HASHES = 8 * 4096, 4


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder that any of Spark's file systems holds; none if there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


@dataclass
class Bucket:
    filter_no: int
    parts: list[int] = field(default_factory=list)


@dataclass
class SeenSet:
    """A slice is about right for 3,000 keys (1 in 80 is then taken for seen and looked up); ``bits`` and ``slice_bits`` are
    chosen for the keys expected in all, and stay as they are for good. Null keys are never seen and never kept."""

    spark: SparkSession
    path: str
    bits: int = 8
    slice_bits: int = 0
    #: What the latest call of ``unseen`` read.
    read: list[str] = field(default_factory=list)

    def commits(self) -> list[str]:
        done = [n for n in listed(self.spark, f"{self.path}/commits") if n[:9].isdigit()]
        return [n for n in done if "_SUCCESS" in listed(self.spark, f"{self.path}/commits/{n}")]

    def state(self) -> tuple[int, dict[int, Bucket]]:
        """Number of the next batch, and what counts of each bucket: 2 ** bits rows, numbers of batches until compacted."""
        done = self.commits()
        if not done:
            return 0, {}
        rows = self.spark.read.schema("bucket int, filter_no int, parts array<int>").json(f"{self.path}/commits/{done[-1]}").collect()
        return int(done[-1][:9]) + 1, {r.bucket: Bucket(r.filter_no, list(r.parts)) for r in rows}

    def done(self, label: str) -> bool:
        return label in (n[10:] for n in self.commits())

    def place(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key, F.lit("bucket"))
        return F.pmod(h, F.lit(1 << self.bits)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(1 << self.slice_bits)).cast("int")

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(SLICE)) for i in range(HASHES)]

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key isn't in the set. Only their keys are shuffled, unless very many are in it."""
        self.read = []
        _, state = self.state()
        if not state:
            return rows
        bucket, part = self.place(F.col("_k"))
        keys = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().withColumns({"bucket": bucket, "slice": part})
        keys = materialize(keys, "asked")
        asked = [r.bucket for r in keys.select("bucket").distinct().collect() if r.bucket in state]
        if not asked:
            return rows
        filters = self.filters({b: state[b] for b in asked})
        byte = lambda p: F.conv(F.hex(F.substr("bits", (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.lit(True)
        for p in self.positions(F.col("_k")):
            hit = hit & (F.getbit(byte(p), (p % 8).cast("int")) == 1)
        maybe = materialize(keys.join(filters, ["bucket", "slice"]).where(hit).select("_k", "bucket"), "maybe")
        touched = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        if not touched:
            return rows
        paths = [f"{self.path}/keys/n={n}/bucket={b}" for b in touched for n in state[b].parts]
        self.read += paths
        known = self.spark.read.schema(f"key {keys.schema['_k'].dataType.simpleString()}").parquet(*paths)
        seen = maybe.join(known, F.col("_k") == F.col("key"), "left_semi").select("_k")
        return rows.join(seen, F.col(key) == F.col("_k"), "left_anti")

    def filters(self, buckets: dict[int, Bucket]) -> DataFrame:
        paths = [f"{self.path}/filters/n={b.filter_no}/bucket={i}" for i, b in buckets.items()]
        self.read += paths
        return self.spark.read.schema("bucket int, slice int, bits binary").option("basePath", f"{self.path}/filters").parquet(*paths).select("bucket", "slice", "bits")

    def commit(self, keys: DataFrame, label: str) -> None:
        """Add the keys (one column, any repeats) as the batch ``label``; nothing, if it is in already."""
        if self.done(label):
            return
        number, state = self.state()
        key = keys.columns[0]
        bucket, part = self.place(F.col("key"))
        rows = keys.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().withColumns({"bucket": bucket, "slice": part})
        to = f"{self.path}/keys/n={number}"
        rows.drop("slice").repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(to)
        new = [int(n.split("=")[1]) for n in listed(self.spark, to) if n.startswith("bucket=")]
        if new:
            added = self.spark.read.schema(f"key {rows.schema['key'].dataType.simpleString()}, bucket int").parquet(to).withColumn("slice", self.place(F.col("key"))[1])
            at = F.explode(F.array(*self.positions(F.col("key"))))
            bits = added.select("bucket", "slice", at.alias("at")).groupBy("bucket", "slice").agg(F.bitmap_construct_agg("at").alias("bits"))
            old = {b: state[b] for b in new if b in state}
            if old:
                bits = bits.unionByName(self.filters(old)).groupBy("bucket", "slice").agg(F.bitmap_or_agg("bits").alias("bits"))
            bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/n={number}")
        for b in new:
            state[b] = Bucket(number, [*(state[b].parts if b in state else []), number])
        self.write_commit(number, label, state)

    def compact(self, label: str = "compact") -> None:
        """One file a bucket for all batches so far. What it replaces stays, for readers that still use it."""
        number, state = self.state()
        paths = [f"{self.path}/keys/n={n}/bucket={i}" for i, b in state.items() for n in b.parts]
        if paths:
            every = self.spark.read.option("basePath", f"{self.path}/keys").parquet(*paths).select("key", F.col("bucket").cast("int"))
            every.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/n={number}")
            self.write_commit(number, f"{label}-{number}", {i: Bucket(b.filter_no, [number]) for i, b in state.items()})

    def write_commit(self, number: int, label: str, state: dict[int, Bucket]) -> None:
        rows = [(i, b.filter_no, b.parts) for i, b in sorted(state.items())]
        table = self.spark.createDataFrame(rows, "bucket int, filter_no int, parts array<int>").coalesce(1)
        table.write.mode("overwrite").json(os.path.join(self.path, "commits", f"{number:09d}-{label}"))


def publish(spark: SparkSession, staged: str, sink: str, number: int) -> None:
    """Move the files of a batch into the sink, under names of the batch's number; those of a broken attempt at it go."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(sink).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path(sink))
    mark = f"batch-{number:09d}-"
    for name in listed(spark, sink):
        if name.startswith(mark):
            fs.delete(path(f"{sink}/{name}"), False)
    for i, name in enumerate(n for n in listed(spark, staged) if n.startswith("part-")):
        if not fs.rename(path(f"{staged}/{name}"), path(f"{sink}/{mark}{i:06d}.parquet")):
            raise OSError(f"can't move {staged}/{name} to {sink}")
    fs.delete(path(staged), True)


def resume_batch(seen: SeenSet, rows: DataFrame, key: str, sink: str, label: str) -> None:
    """Append to ``sink`` the rows of a batch whose key is new, one of each key. A batch that broke off starts over."""
    if seen.done(label):
        return
    number, _ = seen.state()
    staged = f"{seen.path}/staged-{number}"
    seen.unseen(rows, key).dropDuplicates([key]).write.mode("overwrite").parquet(staged)
    keys = materialize(seen.spark.read.schema(rows.schema).parquet(staged).select(key), "keys")
    publish(seen.spark, staged, sink, number)
    seen.commit(keys, label)
