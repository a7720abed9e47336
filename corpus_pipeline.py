"""The corpus pipeline: five stages from documents to token identifiers.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns the columns of documents, but for the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import line_dedup, mixing, near_copies, pieces, quality_rules
from chatloom.llm.common import delete, materialize, own_tables, release, table
from chatloom.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each host go from its texts; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    n = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash near-duplicates, of five-word Jaccard similarity 0.8 or more, stays."""
    return near_copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times."""
    taken = mixing.mix(docs).where("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each row."""
    ids = pieces.encode(docs.select("doc_id", "source", "text"), PIECES)
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL has no SimHash components and no piece encoding; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written, and what it was made from is removed then; tables of
    other queries and runs in this driver are left alone."""
    docs, before = table(spark, sf_dir, "documents"), None
    with own_tables() as written:
        for name, stage in STAGES[:-1]:
            since = len(written)
            docs = materialize(stage(spark, docs, sf_dir), name)
            now = written[-1]
            release(spark, since, keep=[now])
            if before:
                delete(spark, before)
            before = now
        return STAGES[-1][1](spark, docs, sf_dir)
