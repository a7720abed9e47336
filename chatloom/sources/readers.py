"""Scans: JSON documents of any shape, logs, training files, shards, evaluation results.

Raw documents stay text until their shape is known; a document that can't be parsed is
skipped, as a filter, and its file is kept beside each row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.content import dispatch_record
from chatloom.functions.schemas import LOG, PROMPTS, SAMPLE, SCANNED
from chatloom.operators.conversations import uses_tools


def documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, raw: each file as one JSON text; files that aren't JSON go."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    return files.where(F.try_parse_json("raw").isNotNull())


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, record: a list whose first element has a role is one conversation, any other list many records, an
    object one record. An error, if nothing is found."""
    docs = documents(spark, path)
    is_list = F.ltrim("raw", F.lit(" \t\n\r")).startswith("[")
    items = F.from_json(F.when(is_list, F.col("raw")).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]"))), "array<string>")
    whole = is_list & F.get_json_object("raw", "$[0].role").isNotNull()
    found = docs.select("file", F.posexplode(F.when(whole, F.array("raw")).otherwise(items)).alias("pos", "record"))
    if found.isEmpty():
        raise ValueError(f"no records in {path}")
    return found


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records, one document a file, in the schema of logs."""
    return documents(spark, path).select("file", F.from_json("raw", LOG).alias("r")).select("file", "r.*")


def tool_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with tool calls, and the file each is from."""
    docs = documents(spark, path).withColumn("messages", dispatch_record(F.col("raw")))
    return docs.where(uses_tools("messages")).select("messages", F.lit("local").alias("_source"), F.element_at(F.split("file", "/"), -1).alias("_file"))


def exported(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A hub dataset's exported copy, or data in an object store, by any path that Spark reads."""
    return spark.read.format(fmt).load(path)


def prior_output(spark: SparkSession, path: str) -> DataFrame:
    """Samples of an earlier run; blank and malformed lines go. ``.json`` holds one array."""
    many = path.endswith(".json")
    return spark.read.schema(SAMPLE).option("mode", "DROPMALFORMED").option("multiLine", many).json(path)


def training_file(spark: SparkSession, path: str) -> DataFrame:
    """Samples to train on; a malformed line is an error."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def source_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """file, text of the files to scan for secrets; hidden, generated and output folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.col("path")
    ok = name.rlike(f"({'|'.join(map(re.escape, extensions))})$") & ~name.rlike(r"/\.[^/]+/|/node_modules/|/__pycache__/|/venv/|output")
    return files.where(ok).select(name.alias("file"), F.col("content").cast("string").alias("text"))


def feature_shards(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of all shards with ord, which puts them in order of shard, file and row; files of shards may share names."""
    rows = spark.read.parquet(path)
    first = [F.col("shard")] if "shard" in rows.columns else []
    return rows.withColumn("ord", F.struct(*first, F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def lm_head_overlap(weights: DataFrame, vocab: int, hidden: int) -> DataFrame:
    """The block of a weight table (row, vec) that a model of other dimensions can take over."""
    return weights.where(F.col("row") < vocab).withColumn("vec", F.slice("vec", 1, hidden))


def scalars(series: DataFrame) -> DataFrame:
    """run, tag, step, value, file: of files with the same tag the last one counts."""
    last = series.groupBy("run", "tag").agg(F.max("file").alias("file"))
    return series.join(last, ["run", "tag", "file"])


def json_result(spark: SparkSession, path: str) -> DataFrame | None:
    """An evaluation, history or configuration: JSON lines, or a document over several lines; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.json(path)
        return found if "_corrupt_record" not in found.columns else spark.read.option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def prompts(spark: SparkSession, path: str | None = None) -> DataFrame:
    if path:
        raw = spark.read.option("wholetext", True).text(path)
        return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("prompt_no", "prompt"))
    return spark.createDataFrame(list(enumerate(PROMPTS)), "prompt_no int, prompt string")
