"""Shards of even size, and the stateful log of training."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import metrics
from chatloom.sources import shards
from chatloom.streaming import monitor


@pytest.mark.parametrize("block", [7, 50_000])
def test_shards_round_trip(spark, tmp_path, block):
    """Rows of one byte to 5,000, and one of a third of all bytes."""
    rnd = random.Random(block)
    sizes = [rnd.choice([1, 10, 100, 5000]) for _ in range(300)] + [150_000]
    order = rnd.sample(range(301), 301)
    rows = spark.createDataFrame([(o, "x" * s) for o, s in zip(order, sizes, strict=True)], "at int, text string").repartition(5)
    path = str(tmp_path / "out")
    made = shards.write_balanced(rows, path, ["at"], 20_000, F.length("text").cast("long"), block).orderBy("shard").collect()
    want, before = [], 0
    for at, size in sorted(zip(order, sizes, strict=True)):
        want.append((at, before // 20_000, size))
        before += size
    got = shards.read_shards(spark, path)
    assert [(r["at"], r.shard, len(r.text)) for r in got.orderBy("ord").collect()] == want
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(1, 302))
    assert sum(m.bytes for m in made) == sum(sizes) and sum(m.rows for m in made) == 301
    assert all(m.bytes < 20_000 + max(s for _, sh, s in want if sh == m.shard) for m in made)
    assert [m.first_ord for m in made[1:]] == [m.last_ord + 1 for m in made[:-1]]
    some = shards.read_shards(spark, path, made[1].shard, made[1].shard)
    assert some.count() == made[1].rows
    with pytest.raises(FileExistsError):
        shards.write_balanced(rows, path, ["at"], 20_000)


def test_unfinished_shards_are_not_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError, match="no manifest"):
        shards.read_shards(spark, str(tmp_path / "out"))


def logged(steps, every, patience):
    out, best, since, stopped = [], None, 0, False
    for i, (step, value) in enumerate(steps):
        if value is not None and (best is None or value < best):
            best, since = value, 0
        else:
            since += i > 0
        was, stopped = stopped, stopped or since >= patience
        if step % every == 0 or stopped != was:
            out.append((step, value, best, since, stopped))
    return out


def test_step_log_over_restarts(spark, tmp_path):
    """Three starts of the stream from one checkpoint log what a loop over each whole run does; repeats don't count."""
    rnd = random.Random(2)
    runs = {k: [(i, rnd.randint(0, 400) / 4 + 100 - i if i < 40 else 90.0) for i in range(70)] for k in ("a", "b")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    try:
        for part in range(3):
            rows = [(k, s, v) for k, all_ in runs.items() for s, v in all_[max(part * 25 - 3, 0) : part * 25 + 25]]
            spark.createDataFrame(rows, "run string, step long, value double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema("run string, step long, value double").json(str(tmp_path / "in"))
            made = monitor.step_log(stream, 10, 5).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
            made.format("json").option("path", str(tmp_path / "out")).outputMode("append").start().awaitTermination()
        out = spark.read.schema(monitor.LOGGED).json(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for k, steps in runs.items():
        assert sorted((r.step, r.value, r.best, r.misses, r.stopped) for r in out if r.run == k) == logged(steps, 10, 5)
    rows = spark.createDataFrame([(k, s, v, 1.0) for k, all_ in runs.items() for s, v in all_], "run string, step long, val double, train double")
    batch = metrics.early_stopping(rows, ["run"], "step", "val", "train", 5)
    kept = {(r.run, r.step): (r.misses, r.stopped) for r in batch.collect()}
    assert all(kept[r.run, r.step] == (r.misses, r.stopped) for r in out)
