"""Sinks: JSON lines, shards, metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, limit: int | None = None, columns: list[str] | None = None) -> None:
    """Rows as JSON lines, nulls included; ``limit`` of 0 or None means all."""
    rows = rows.select(*columns) if columns else rows
    rows = rows.limit(limit) if limit else rows
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_samples(rows: DataFrame, path: str, fmt: str = "openai", limit: int | None = None) -> None:
    """``openai``: messages; any other name: the training projection."""
    columns = ["messages"] if fmt == "openai" else ["input_text", "output_text", "source", "dataset_name"]
    write_jsonl(rows, path, limit, [c for c in columns if c in rows.columns])


def write_unified(rows: DataFrame, path: str) -> None:
    write_jsonl(rows, path, columns=["messages", "loss_mask_segments"])


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("errorifexists").json(path)


def write_shards(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """Feature rows in a folder per shard; rows stay ragged."""
    rows.repartition(shard).write.mode("errorifexists").partitionBy(shard).parquet(path)


def append_metrics(series: DataFrame, path: str, every: int = 10) -> None:
    series.where(F.col("step") % every == 0).write.mode("append").parquet(path)


def stamped(stem: str, at: str = "current_timestamp()") -> Column:
    """A file name with the time as YYYYMMDD_HHMMSS."""
    return F.concat(F.lit(f"{stem}_"), F.date_format(F.expr(at), "yyyyMMdd_HHmmss"), F.lit(".jsonl"))


def write_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array in one file, a line each; one task writes it, but none holds it whole."""
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    edges = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "k int, value string")
    every = edges.unionByName(rows.select(F.lit(1).alias("k"), line)).coalesce(1).sortWithinPartitions("k")
    numbered = every.withColumn("i", F.monotonically_increasing_id())
    comma = F.when((F.col("k") == 1) & (F.col("i") > 1), F.lit(",")).otherwise(F.lit(""))
    numbered.select(F.concat(comma, "value").alias("value")).write.mode("errorifexists").text(path)


def latest(files: DataFrame, path: str = "path") -> DataFrame:
    """The file whose name, which ends in a time, sorts last."""
    return files.agg(F.max_by(path, F.element_at(F.split(path, "/"), -1)).alias(path))


def write_json(rows: DataFrame, path: str) -> None:
    """Histories, evaluation results and other tables as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def output_bytes(rows: DataFrame, each: int = 2048) -> DataFrame:
    """Estimated size of a dataset."""
    return rows.agg((F.count(F.lit(1)) * each).alias("bytes"))
