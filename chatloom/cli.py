"""Command line: generate a dataset, distil logs, scan for secrets, evaluate, and write the tables of plots. Options mirror
the functions in plans.pipelines and plans.reports."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import conversations as V
from chatloom.operators import preflight, sampling, secrets
from chatloom.plans import pipelines, reports
from chatloom.sources import events, lines, readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chatloom", description=__doc__)
    to = p.add_subparsers(dest="command", required=True)
    g = to.add_parser("generate", help="mix, deduplicate and mask conversations of several sources")
    g.add_argument("--source", action="append", required=True, metavar="NAME=PATH", help="JSON documents of any known shape; may be repeated")
    g.add_argument("--ratio", help="name:share,name:share; needed for several sources")
    g.add_argument("--limit", type=int, default=1000)
    g.add_argument("--min-words", type=int, default=0)
    g.add_argument("--no-dedup", action="store_true")
    g.add_argument("--resume", help="earlier output, whose samples come first and aren't repeated")
    g.add_argument("--format", choices=("openai", "sharegpt"), default="openai")
    g.add_argument("--as-array", action="store_true", help="one JSON array instead of JSON lines")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--output", required=True)
    d = to.add_parser("distill", help="filter log records to samples with loss masks")
    d.add_argument("--logs", required=True)
    d.add_argument("--target", type=int, default=1000)
    d.add_argument("--min-response", type=int, default=30)
    d.add_argument("--check-code", action="store_true")
    d.add_argument("--stop-on-secret", action="store_true")
    d.add_argument("--keep-secrets", action="store_true")
    d.add_argument("--output", required=True)
    s = to.add_parser("scan-secrets", help="findings in a tree of source files")
    s.add_argument("path")
    s.add_argument("--output")
    s.add_argument("--context", action="store_true", help="with two lines to either side of each finding")
    e = to.add_parser("evaluate", help="speed, acceptance and losslessness of decoding runs")
    e.add_argument("--samples", required=True, help="JSON lines of decoding runs")
    e.add_argument("--baseline", help="the method that others are held against")
    e.add_argument("--heads", type=int, default=4)
    e.add_argument("--output", required=True)
    t = to.add_parser("plot-tables", help="what the plots of training and of two evaluations are drawn from")
    t.add_argument("--logs", help="folder of event files")
    t.add_argument("--model1", help="samples of one evaluation")
    t.add_argument("--model2", help="and of another")
    t.add_argument("--method", help="the method to compare")
    t.add_argument("--window", type=int, default=10)
    t.add_argument("--output", required=True)
    f = to.add_parser("preflight", help="checks of a training set; fails if it isn't fit to train on")
    f.add_argument("dataset")
    f.add_argument("--output")
    return p


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    named = dict(x.split("=", 1) for x in a.source)
    if len(named) > 1 and not a.ratio:
        raise SystemExit("several sources need --ratio")
    ratios = sampling.parse_ratios(a.ratio) if a.ratio else None
    if ratios and set(ratios) != set(named):
        raise SystemExit("--ratio must name every source")
    rows = None
    for i, (name, path) in enumerate(sorted(named.items())):
        part = V.samples(readers.records(spark, path)).select(F.struct(F.lit(i), "file", "pos").alias("at"), "messages", F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    rows = sampling.global_rank(rows, [F.col("at")])
    prior = readers.prior_output(spark, a.resume) if a.resume else None
    if prior is not None:
        prior = prior.withColumns({"ord": -F.monotonically_increasing_id() - 1, "source": F.lit("prior")}).select("ord", "source", "messages")
    out = pipelines.generate(rows.select("ord", "source", "messages"), a.limit, ratios, prior, a.min_words, not a.no_dedup, a.seed)
    if a.format == "sharegpt":
        out = out.select(V.to_sharegpt("messages").alias("conversations"), "loss_mask_segments").where("conversations is not null")
    else:
        out = out.select("messages", "loss_mask_segments")
    (writers.write_array if a.as_array else writers.write_jsonl)(out, a.output)


def distill(spark: SparkSession, a: argparse.Namespace) -> None:
    o = pipelines.Distill(target=a.target, min_response=a.min_response, check_code=a.check_code, stop_on_secret=a.stop_on_secret, mask_secrets=not a.keep_secrets)
    rows = sampling.global_rank(readers.logs(spark, a.logs).withColumn("source", F.lit("local")), [F.col("file")])
    writers.write_unified(pipelines.distill(rows, o), a.output)


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    every = lines.source_lines(spark, a.path)
    found = lines.scan_lines(every).withColumn("severity", secrets.severity(F.col("secret_type")))
    if a.context:
        found = lines.surrounding(found, every)
    if a.output:
        writers.write_findings(found, a.output)
    found.groupBy("severity", "secret_type").count().orderBy(F.desc("count")).show(truncate=False)


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(reports.SAMPLES).option("mode", "FAILFAST").json(path)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    tables = reports.evaluation_tables(samples(spark, a.samples), a.baseline, a.heads)
    reports.write_tables(tables, a.output)
    tables["totals"].show(truncate=False)


def plot_tables(spark: SparkSession, a: argparse.Namespace) -> None:
    if bool(a.model1) != bool(a.model2) or (a.model1 and not a.method) or not (a.logs or a.model1):
        raise SystemExit("give --logs, or --model1, --model2 and --method")
    tables = reports.training_tables(readers.scalars(events.read_scalars(spark, a.logs)), a.window) if a.logs else {}
    if a.model1:
        tables["comparison"] = reports.comparison_table(samples(spark, a.model1), samples(spark, a.model2), a.method)
    reports.write_tables(tables, a.output)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    found = preflight.report(readers.prior_output(spark, a.dataset), preflight.dataset_checks())
    if a.output:
        writers.write_json(found, a.output)
    found.show(truncate=False)
    if not preflight.ready(found):
        raise SystemExit("the dataset isn't ready")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"chatloom {a.command}").getOrCreate()
    {"generate": generate, "distill": distill, "scan-secrets": scan, "evaluate": evaluate, "plot-tables": plot_tables, "preflight": check}[a.command](spark, a)


if __name__ == "__main__":
    main()
