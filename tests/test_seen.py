"""The stored seen-set: exact answers, bounded reads, batches that break off, and streams."""

import os

import pytest

from chatloom.operators import seen as S
from chatloom.streaming import streams


def size(paths):
    return sum(os.path.getsize(os.path.join(p, f)) for p in paths for f in os.listdir(p) if f.endswith(".parquet"))


def test_answers_and_compaction(spark, tmp_path):
    made = S.SeenSet(spark, str(tmp_path / "set"), bits=3)
    keys = lambda a, b: spark.range(a, b).selectExpr("concat('k', id) AS k", "id AS v")
    assert made.unseen(keys(0, 50), "k").count() == 50
    for i in range(4):
        made.commit(keys(i * 100, i * 100 + 150).select("k"), f"b{i}")
    rows = keys(400, 500).unionByName(spark.createDataFrame([(None, -1), ("k1", -2), ("new", -3)], "k string, v long"))
    want = [-3, -1, *range(450, 500)]
    assert sorted(r.v for r in made.unseen(rows, "k").collect()) == want
    made.compact()
    assert sorted(r.v for r in made.unseen(rows, "k").collect()) == want
    assert all(len(b.parts) == 1 for b in made.state()[1].values())
    made.commit(keys(450, 460).select("k"), "b9")
    assert sorted(r.v for r in made.unseen(rows, "k").collect()) == [-3, -1, *range(460, 500)]


def test_reads_stay_flat(spark, tmp_path):
    """Batches of new keys read filters, whose size doesn't grow, and hardly any keys; one bucket's batch reads one bucket."""
    made = S.SeenSet(spark, str(tmp_path / "set"), bits=2)
    read = []
    for i in range(12):
        rows = spark.range(i * 40, i * 40 + 40).selectExpr("concat('key-', id) AS k")
        assert made.unseen(rows, "k").count() == 40
        read.append(size(made.read))
        made.commit(rows, f"b{i}")
    assert max(read[6:]) < 1.7 * max(read[1:6])
    one = spark.createDataFrame([("key-7",)], "k string")
    assert made.unseen(one, "k").count() == 0
    assert len({p.split("bucket=")[1] for p in made.read}) == 1


def test_batch_that_breaks_off(spark, tmp_path, monkeypatch):
    made, sink = S.SeenSet(spark, str(tmp_path / "set")), str(tmp_path / "sink")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    with monkeypatch.context() as m:
        m.setattr(S.SeenSet, "write_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            S.resume_batch(made, rows, "k", sink, "0")
    S.resume_batch(made, rows, "k", sink, "0")
    S.resume_batch(made, rows, "k", sink, "0")
    S.resume_batch(made, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), "k", sink, "1")
    assert sorted((r.k, r.v) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_stream_into_older_sink(spark, tmp_path):
    out = str(tmp_path / "sink")
    spark.createDataFrame([("old",)], "h string").write.parquet(out)
    for i, ck in enumerate(("ck1", "ck2")):  # a second stream numbers its batches from 0 again
        spark.createDataFrame([("old",), (f"n{i}",)], "h string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        streams.resume_into(streams.read_json(spark, str(tmp_path / "in"), "h string"), out, "h", str(tmp_path / ck)).awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(out).collect()) == ["n0", "n1", "old"]
