"""Thresholds, blocks of series, anchors and bounded reports, against plain Python."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.operators import dedup, evaluation, metrics, passages, preflight, sampling, secrets, selection, series
from chatloom.plans import large as _large  # noqa: F401  adds its queries to the catalogue
from chatloom.plans.catalogue import QUERIES, SQL


def digest(k):
    return hashlib.md5(f"42:{k}".encode()).hexdigest() if k is not None else ""


@pytest.mark.parametrize("few", [1, 3, 256])
def test_quota_by_thresholds(spark, few):
    rnd = random.Random(few)
    rows = [(i, rnd.choice("aaaab"), i % 7) for i in range(3000)] + [(9_999, "a", j) for j in range(400)] + [(None, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, v int").repartition(5)
    take = {"a": 700, "b": 90, "c": 5, "d": 0}
    place = F.coalesce(sampling.seeded(F.col("doc_id")), F.lit(""))
    got = selection.take_first(df, "source", place, "doc_id", take, few)
    want = {s: Counter(k for _, k in sorted((digest(r[0]), -1 if r[0] is None else r[0]) for r in rows if r[1] == s)[:n]) for s, n in take.items()}
    for s in take:
        assert Counter(-1 if r.doc_id is None else r.doc_id for r in got.where(F.col("source") == s).collect()) == want[s]


def test_quota_has_no_sort(spark):
    plan = sampling.quota_sample(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")), {"a": 1.0}, 100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort" not in text and plan.count() == 100
    tied = spark.range(3000).select(F.lit(4).alias("doc_id"), F.lit("a").alias("source"))
    assert sampling.quota_sample(tied, {"a": 1.0}, 100).count() == 100
    assert sampling.quota_sample(tied.limit(0), {"a": 1.0}, 100).count() == 0


@pytest.mark.parametrize(("modulus", "target"), [(1, 10), (10, 50), (500, 7), (10**9, 3), (3, 0)])
def test_refill(spark, tmp_path, modulus, target):
    """The rows that a loop over the order would give; what is beyond them isn't read."""
    rows = spark.range(20_000).select((F.col("id") * 3 + 5).alias("at"), (F.col("id") * 7919 % 100_003).alias("v")).repartition(4)
    got = selection.fill_to(rows, F.col("v") % modulus == 0, target, "at", buckets=16, few=8)
    want = [i * 3 + 5 for i in range(20_000) if (i * 7919 % 100_003) % modulus == 0][:target]
    assert sorted(r.at for r in got.rows.collect()) == want
    if target == 50:
        assert got.up_to == want[-1] and got.reads <= 6
        path = str(tmp_path / "t")
        rows.write.parquet(path)
        kept = sampling.refill(spark.read.parquet(path), F.col("v") % 10 == 0, 50, "at")
        assert "PushedFilters: [" in kept._jdf.queryExecution().executedPlan().toString() and "LessThan(at" in kept._jdf.queryExecution().executedPlan().toString()


def test_refill_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, True), (2, True), (2, True), (1, None), (3, True)], "at long, ok boolean")
    assert [r.at for r in sampling.refill(rows, F.col("ok"), 1, "at").collect()] == [2]
    assert sorted(r.at for r in sampling.refill(rows, F.col("ok"), 2, "at").collect()) == [2, 2]
    assert sampling.refill(rows.limit(0), F.col("ok"), 2, "at").count() == 0
    same = spark.range(1000).select(F.lit(7).alias("at"), F.lit(True).alias("ok"))
    assert sampling.refill(same, F.col("ok"), 30, "at").count() == 30


@pytest.fixture(scope="module")
def curves(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.randint(0, 1000) / 8 if rnd.random() > 0.1 else None) for k, n in (("a", 400), ("b", 7), (None, 90), ("c", 1)) for i in range(n)]
    return spark.createDataFrame(rows, "run string, step int, value double").repartition(7)


@pytest.mark.parametrize("rows", [6, 50, 10_000])
def test_blocks_against_windows(spark, curves, rows):
    w = Window.partitionBy("run").orderBy("step")
    laid = series.laid_out(curves, ["run"], ["step"], rows)
    got = series.moving(laid, ["run"], 3, 5, rows, m=F.avg("value"), n=F.count("value"))
    want = curves.withColumns({"m": F.avg("value").over(w.rowsBetween(-3, 5)), "n": F.count("value").over(w.rowsBetween(-3, 5))})
    both = lambda df, *c: sorted(map(repr, df.select("run", "step", *c).collect()))
    assert both(got, "m", "n") == both(want, "m", "n")
    folds = {"s": ("sum", F.col("value")), "lo": ("min", F.col("value")), "hi": ("max", F.col("value"))}
    for exclusive in (False, True):
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        want = curves.withColumns({"s": F.sum("value").over(frame), "lo": F.min("value").over(frame), "hi": F.max("value").over(frame)})
        assert both(series.running(laid, ["run"], exclusive, **folds), "s", "lo", "hi") == both(want, "s", "lo", "hi")
    with pytest.raises(ValueError, match="as long as"):
        series.moving(laid, ["run"], rows + 1, 0, rows)


@pytest.mark.parametrize("rows", [4, 10_000])
def test_stop_flag_against_a_loop(spark, curves, rows):
    e = curves.withColumns({"val": F.col("value"), "train": F.col("step") * 1.0})
    got = {(r.run, r.step): (r.improved, r.misses, r.stopped) for r in metrics.early_stopping(e, ["run"], "step", "val", "train", 5, rows=rows).collect()}
    want = {}
    for run in ("a", "b", None, "c"):
        best, since, stopped = None, 0, False
        for i, r in enumerate(sorted((r for r in e.collect() if r.run == run), key=lambda r: r.step)):
            watched = r.train if r.val is None else r.val
            improved = best is None or watched < best
            best, since = (watched, i) if improved else (best, since)
            stopped = stopped or (i - since >= 5 and r.val is not None)
            want[run, r.step] = (improved, i - since, stopped)
    assert got == want


@pytest.mark.parametrize(("key", "least"), [(None, 3), ("doc_id", 3), ("doc_id", 1)])
def test_passages(spark, key, least):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300 if least > 1 else 30)] + ["é", "", "日本"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60))) for _ in range(120)] + [None, "", " ", "one"]
    found = {" ".join(rnd.choices(vocabulary, k=rnd.randint(least, 6))) for _ in range(150)}
    for t in texts[:40]:
        if t and len(t) > 30:
            at = rnd.randint(0, 20)
            found.add(t[at : at + rnd.randint(3, 40)])
    found = {p for p in found if len(p.split(" ")) >= least}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(p,) for p in found] + [(None,)], "passage string")
    want = [i for i, t in enumerate(texts) if t is not None and any(p in t for p in found)]
    assert len(want) > 20 and (least == 1 or len(want) < 100)
    assert sorted(r.doc_id for r in dedup.holding(docs, items, few=20, key=key).collect()) == want


def test_postings_carry_no_texts(spark):
    """Of 3,000 passages the anchors are rare words, so few rows are fetched to be compared."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("common"), F.lit(i)) for i in range(40)], F.concat(F.lit("rare"), "id"), F.lit("end of text")).alias("text"))
    items = spark.range(3000).select(F.concat(F.lit("common38 common39 rare"), (F.col("id") + 395).cast("string"), F.lit(" end of")).alias("passage"))
    made = passages.anchored(items, docs).collect()
    assert all(any(w.startswith("rare") for w in r.pw[r.at : r.at + r.n]) for r in made)
    assert sorted(r.doc_id for r in dedup.holding(docs, items, few=10, key="doc_id").collect()) == [395, 396, 397, 398, 399]


def test_report_is_bounded(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 40 == 0, "HIGH").when(F.col("id") % 3 == 0, "LOW").otherwise("MEDIUM").alias("severity"), (F.col("id") * 7 % 2000).alias("at"))
    got = secrets.report(rows, ["at"])
    medium = sorted(r["at"] for r in rows.where("severity = 'MEDIUM'").collect())
    assert sorted(r["at"] for r in got.where("severity = 'MEDIUM'").collect()) == medium[:5]
    assert got.where("severity = 'HIGH'").count() == 50 and {r.n for r in got.where("severity = 'MEDIUM'").collect()} == {len(medium)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert secrets.report(rows.limit(0), ["at"]).count() == 0


def test_preflight(spark, tmp_path):
    mask = "struct<train_indices:array<int>>"
    rows = spark.createDataFrame([([1, 2], ([1],)), ([1], ([],)), ([1], ([4],)), (None, None)], f"messages array<int>, loss_mask_segments {mask}")
    want = {"has_messages": (1, "failed"), "has_loss_mask_segments": (1, "failed"), "has_train_indices": (1, "failed"), "has_nonzero_train_indices": (2, "warned"), "indices_in_range": (2, "failed")}
    found = preflight.report(rows, preflight.dataset_checks())
    assert {r.check: (r.failed, r.status) for r in found.collect()} == want and not preflight.ready(found)
    written = preflight.write_checked(rows, preflight.dataset_checks(), str(tmp_path / "out"))
    assert {r.check: (r.failed, r.status) for r in written.collect()} == want
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    none = preflight.report(rows.limit(0), preflight.dataset_checks())
    assert {r.status for r in none.collect()} == {"failed", "warned"}
    ids = spark.createDataFrame([([1, 2], [1, 2]), ([3], [4])], "a array<int>, b array<int>")
    assert {r.check: r.status for r in preflight.report(ids, preflight.tokenizer_checks(F.col("a"), F.col("b"))).collect()} == {"target_encodes": "passed", "drafter_encodes": "passed", "vocab_compatible": "warned", "within_max_length": "passed"}
    vectors = spark.createDataFrame([([[1.0, 2.0]],), ([[1.0]],)], "f array<array<double>>")
    assert {r.check: r.status for r in preflight.report(vectors, preflight.feature_checks("f", 2)).collect()} == {"features_exist": "passed", "hidden_dim_match": "failed"}
    config = spark.createDataFrame([(8,)], "hidden_size int")
    assert {r.check: r.status for r in preflight.report(config, preflight.config_checks(config)).collect()} == {"config_hidden_size": "passed", "config_num_hidden_layers": "failed"}


def test_evaluation(spark):
    rows = [("base", 1, 3.0, 3, 10.0, 2.0, "x"), ("base", 2, 1.0, 1, 2.0, 4.0, "y"), ("fast", 1, 8.0, 2, 10.0, 1.0, " x "), ("fast", 2, 0.0, 0, 4.0, 0.0, "z")]
    df = spark.createDataFrame(rows, "method string, prompt_no int, accepted double, passes int, tokens double, seconds double, output string")
    assert [(r.method, r.speedup) for r in evaluation.speed_up(df, "base").collect()] == [("fast", 5.0)]
    assert [r.speedup for r in evaluation.speed_up(df, "none").collect()] == [1.0, 1.0]
    assert sorted((r.method, r.prompt_no, r.speedup, r["mean"]) for r in evaluation.speed_up_series(df).collect())[2:] == [("fast", 1, 4.0, 2.0), ("fast", 2, 0.0, 2.0)]
    got = evaluation.lossless(df, "base").first()
    assert (got.method, got.verified, got.total, got.match_rate) == ("fast", 1, 2, 0.5)


def test_preflight_report_asks_for_words_in_the_message_itself(spark, tmp_path):
    """A word in lower case may stand inside another one of its message; in another message it doesn't count."""
    said = [(1, 0, "user", "To stor it"), (2, 0, "user", "To go"), (3, 0, "user", "To"), (3, 1, "assistant", "stor"), (4, 0, "user", "all low"), (5, 0, "user", None), (5, 1, "user", "ok")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(at := str(tmp_path / "conversations.parquet"))
    got = {r.check: (r.failed, r.rows) for r in QUERIES["preflight_report"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/*.parquet'")
    assert got == {k: (failed, n) for k, _, failed, n, _ in duck.execute(SQL["preflight_report"]).fetchall()}
    assert got["vocab_compatible"] == (2, 5)
