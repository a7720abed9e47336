"""Scans, sinks and small operators that no query of the catalogue reads or writes files for."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom import cli
from chatloom.functions import content as C
from chatloom.functions import vectors as A
from chatloom.operators import conversations as V
from chatloom.operators import metrics, secrets
from chatloom.plans import reports
from chatloom.sources import readers, writers


def test_tool_conversations(spark, tmp_path):
    """Only conversations with tool calls, each with its file."""
    call = [{"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "", "tool_calls": call}]}))
    (tmp_path / "b.json").write_text(json.dumps({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}))
    (tmp_path / "c.json").write_text("not json")
    got = readers.tool_conversations(spark, str(tmp_path)).collect()
    assert [(r._file, r._source, r.messages[1].tool_calls[0].function.name) for r in got] == [("a.json", "local", "f")]


def test_feature_shards_and_weights(spark, tmp_path):
    """Shards written apart and read in order; the block of weights that another model can take."""
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 3).cast("int").alias("shard"), F.array(F.col("id") * 1.0).alias("vec")).repartition(4)
    writers.write_shards(rows, str(tmp_path / "f"))
    got = readers.feature_shards(spark, str(tmp_path / "f"))
    assert got.count() == 40 and got.select("ord").distinct().count() == 40 and sorted(got.select("shard").distinct().toPandas().shard) == [0, 1, 2]
    weights = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (5, [4.0, 5.0, 6.0])], "row int, vec array<double>")
    assert [(r.row, r.vec) for r in readers.lm_head_overlap(weights, 5, 2).collect()] == [(0, [1.0, 2.0])]


def test_prompts(spark, tmp_path):
    """Prompts of a file, or our own."""
    (tmp_path / "p.json").write_text('["one", "two"]')
    assert [(r.prompt_no, r.prompt) for r in readers.prompts(spark, str(tmp_path / "p.json")).orderBy("prompt_no").collect()] == [(0, "one"), (1, "two")]
    assert readers.prompts(spark).count() == 5


def test_samples_sink(spark, tmp_path):
    """K1: messages alone, or the training projection, nulls written; a limit of 0 is none."""
    rows = spark.createDataFrame([([("user", None, None)], "in", "out", "s", None), ([("user", "b", None)], "i", "o", "s", "d")], "messages array<struct<role:string,content:string,tool_calls:array<string>>>, input_text string, output_text string, source string, dataset_name string")
    writers.write_samples(rows, str(tmp_path / "a"), limit=0)
    writers.write_samples(rows, str(tmp_path / "b"), "training", limit=1)
    a = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "a")).collect()]
    b = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert len(a) == 2 and all(set(x) == {"messages"} for x in a) and {"role": "user", "content": None, "tool_calls": None} in [x["messages"][0] for x in a]
    assert len(b) == 1 and set(b[0]) == {"input_text", "output_text", "source", "dataset_name"}


def test_metric_sinks(spark, tmp_path):
    """Histories and evaluations are read back; every tenth step is appended."""
    rows = spark.range(25).select(F.col("id").alias("step"), (F.col("id") / 2).alias("loss"))
    writers.append_metrics(rows, str(tmp_path / "m"))
    writers.append_metrics(rows.where("step >= 20"), str(tmp_path / "m"))
    assert sorted(r.step for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [0, 10, 20, 20]
    writers.write_json(rows, str(tmp_path / "h"))
    assert sorted((r.step, r.loss) for r in readers.json_result(spark, str(tmp_path / "h")).collect()) == [(i, i / 2) for i in range(25)]


def test_files_by_time(spark):
    """The latest of stamped names, and the size that a dataset will take."""
    one = spark.range(1).select(writers.stamped("out", "timestamp'2024-05-06 07:08:09'").alias("path")).first().path
    assert one == "out_20240506_070809.jsonl"
    files = spark.createDataFrame([("/b/out_20240506_070809.jsonl",), ("/a/out_20250101_000000.jsonl",), ("/z/out_20231231_235959.jsonl",)], "path string")
    assert writers.latest(files).first().path == "/a/out_20250101_000000.jsonl"
    assert writers.output_bytes(spark.range(7)).first().bytes == 7 * 2048


def test_own_transform(spark):
    """A caller's own transform in place of the dispatch of shapes; records without messages go."""
    records = spark.createDataFrame([("q|a",), ("",)], "record string")
    def transform(rows):
        parts = F.split("record", r"\|")
        turn = lambda role, i: F.struct(F.lit(role).alias("role"), F.get(parts, F.lit(i)).alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))
        return rows.withColumn("messages", F.when(F.col("record") != "", F.array(turn("user", 0), turn("assistant", 1))))

    got = V.samples(records, transform=transform).collect()
    assert [(r.input_text, r.output_text) for r in got] == [(got[0].input_text, got[0].output_text)] and "q" in got[0].input_text and "a" in got[0].output_text


def test_small_metrics(spark):
    """Epoch means, bars of heads, test data told by its text, token loss and accuracy."""
    steps = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "epoch int, loss double")
    assert {r.epoch: r.loss for r in metrics.epoch_means(steps, ["epoch"]).collect()} == {1: 3.0, 2: 5.0}
    bars = metrics.acceptance_bars(spark.createDataFrame([(1, 0.5)], "pos int, rate double")).first()
    assert (bars["head"], bars["percent"]) == ("Head 1", 50.0)
    raw = spark.createDataFrame([("an Example key",), ("AKIA1",), ("FAKEd",)], "raw string")
    assert [r.raw for r in raw.where(secrets.not_test_data(F.col("raw"))).collect()] == ["AKIA1"]
    tokens = spark.createDataFrame([("b", [1.0, 0.0], [0.0, 1.0], 1), ("b", [0.0, 2.0], [0.0, 2.0], 1), ("b", [9.0, 0.0], [0.0, 9.0], 0)], "b string, student array<double>, teacher array<double>, mask int")
    got = A.token_loss(tokens, ["b"]).first()
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    kl = sum(float((soft(t) * (np.log(soft(t)) - np.log(soft(s)))).sum()) for s, t in ((np.array([1.0, 0]), np.array([0, 1.0])), (np.array([0, 2.0]), np.array([0, 2.0]))))
    assert got.kl == pytest.approx(kl / 4, rel=1e-6) and got.accuracy == pytest.approx(50, rel=1e-6)


def test_normalisers_on_odd_content(spark):
    """Content is the JSON of a value; text stays, parts of a list are told, and what isn't JSON gives null."""
    rows = spark.createDataFrame([(0, '"plain"'), (1, None), (2, '[{"type": "text", "text": "part"}]'), (3, "{broken"), (4, '"a `tick` [x"')], "i int, c string")
    for f in (C.content_string, C.parse_content, C.clean_content):
        got = {r.i: r.t for r in rows.select("i", f(F.col("c")).alias("t")).collect()}
        assert got[0] == "plain" and got[1] is None and got[3] is None and "tick" in got[4]
        assert got[2] is None if f is C.clean_content else "part" in got[2]  # a list has no fences to take off


def event(tag, step, value):
    field = lambda n, kind, raw: bytes([n << 3 | kind]) + (bytes([len(raw)]) if kind == 2 else b"") + raw
    body = field(2, 0, bytes([step])) + field(5, 2, field(1, 2, field(1, 2, tag.encode()) + field(2, 5, struct.pack("<f", value))))
    return struct.pack("<Q", len(body)) + b"\0" * 4 + body + b"\0" * 4


def test_evaluate_and_plot_commands(spark, tmp_path):
    """The tables of evaluations, of training and of a comparison, from the command line."""
    rows = [
        {"method": "base", "prompt_no": 1, "accepted": 4.0, "passes": 4, "tokens": 8.0, "seconds": 4.0, "output": "x", "history": [1, 1, 1, 1]},
        {"method": "fast", "prompt_no": 1, "accepted": 6.0, "passes": 2, "tokens": 8.0, "seconds": 1.0, "output": "x", "history": [4, 2]},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "s2.json").write_text(json.dumps({**rows[1], "accepted": 2.0, "history": [1, 1]}))
    cli.main(["evaluate", "--samples", str(tmp_path / "s.json"), "--baseline", "base", "--output", str(tmp_path / "e")])
    read = lambda *p: spark.read.json(str(tmp_path.joinpath(*p))).collect()
    assert [(r.method, r.speedup) for r in read("e", "speedup")] == [("fast", 4.0)]
    assert {(r.method, r.pos): r.percent for r in read("e", "heads")} == {("base", 1): 100.0, **{("base", i): 0.0 for i in (2, 3, 4)}, ("fast", 1): 100.0, ("fast", 2): 100.0, ("fast", 3): 50.0, ("fast", 4): 50.0}
    assert {r.method: (r.speedup, r["mean"]) for r in read("e", "speedup_series")} == {"base": (1.0, 1.0), "fast": (3.0, 3.0)}
    assert [(r.verified, r.total) for r in read("e", "lossless")] == [(1, 1)]
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "events.out.1").write_bytes(b"".join(event("loss", i, 10.0 - i) for i in range(1, 13)))
    cli.main(["plot-tables", "--logs", str(tmp_path / "run1"), "--model1", str(tmp_path / "s.json"), "--model2", str(tmp_path / "s2.json"), "--method", "fast", "--output", str(tmp_path / "p")])
    curve = {r.step: r.smoothed for r in read("p", "curve")}
    assert len(curve) == 12 and curve[6] == pytest.approx(np.mean([10.0 - i for i in range(1, 12)]))
    assert [(r["count"], r.final, r.all_zero) for r in read("p", "summary")] == [(12, -2.0, False)]
    assert {r.metric: (r.model1, r.model2) for r in read("p", "comparison")}["mean_mal"] == (3.0, 1.0)
    with pytest.raises(SystemExit):
        cli.main(["plot-tables", "--output", str(tmp_path / "q")])


def test_preflight_command(spark, tmp_path):
    good = {"messages": [{"role": "user", "content": "a", "tool_calls": None}, {"role": "assistant", "content": "b", "tool_calls": None}], "loss_mask_segments": {"train_indices": [1], "ignore_indices": [0], "segments": []}}
    (tmp_path / "ok.jsonl").write_text(json.dumps(good))
    cli.main(["preflight", str(tmp_path / "ok.jsonl"), "--output", str(tmp_path / "r")])
    assert {r.status for r in spark.read.json(str(tmp_path / "r")).collect()} == {"passed"}
    (tmp_path / "bad.jsonl").write_text(json.dumps({**good, "messages": []}))
    with pytest.raises(SystemExit, match="ready"):
        cli.main(["preflight", str(tmp_path / "bad.jsonl")])


def test_report_tables_of_nothing(spark):
    none = spark.createDataFrame([], reports.SAMPLES)
    assert all(t.count() == 0 for t in reports.evaluation_tables(none, "base").values())
