"""Exact deduplication with an explicit order, and resuming from earlier output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import passages
from chatloom.operators.conversations import body, call_lines, first_of
from chatloom.operators.tables import materialize


def user_hash(messages: Column | str) -> Column:
    """SHA-256 of the first user text, lower-cased and trimmed; of the empty text if there is none."""
    return F.sha2(F.lower(T.strip(F.coalesce(first_of(messages, "user"), F.lit("")))), 256)


def sample_hash(messages: Column | str) -> Column:
    """SHA-256 of all roles, contents and tool calls."""
    def parts(m: Column) -> Column:
        calls = F.transform(F.coalesce(m.tool_calls, F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), lambda c: F.concat(F.lit("tool:"), F.coalesce(c.function["name"], F.lit("")), F.lit(":"), F.coalesce(c.function.arguments, F.lit(""))))
        return F.concat(F.array(F.concat(F.coalesce(m.role, F.lit("")), F.lit(":"), body(m))), calls)

    return F.sha2(F.array_join(F.flatten(F.transform(messages, parts)), "|"), 256)


def pair_hash(input_text: Column, output_text: Column) -> Column:
    """SHA-256 of input and output without a separator between them."""
    return F.sha2(F.concat(F.coalesce(input_text, F.lit("")), F.coalesce(output_text, F.lit(""))), 256)


def first_keys(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """key, order of each key's first row: a partial aggregate, so copies shrink before the shuffle."""
    return rows.select(key.alias("_h"), F.col(order).alias("_o")).groupBy("_h").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_copies"))


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by ``order``, which is unique.

    Only hashes and orders are grouped; rows join by their unique order, so the copies of
    one text, however many, don't meet in one task.
    """
    first = first_keys(rows, key, order).select(F.col("_o").alias(order))
    return rows.join(first, order, "left_semi")


def dedup_stats(rows: DataFrame, key: Column) -> DataFrame:
    counts = rows.groupBy(key.alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(total.cast("long").alias("total"), (total - F.count(F.lit(1))).cast("long").alias("duplicates"), F.count(F.lit(1)).alias("unique"))


def resume(prior: DataFrame, new: DataFrame, hashed: str = "h") -> DataFrame:
    """Earlier rows, then the new rows whose hash doesn't occur among them."""
    fresh = new.join(prior.select(hashed).distinct(), hashed, "left_anti")
    return prior.withColumn("batch", F.lit(0)).unionByName(fresh.withColumn("batch", F.lit(1)), allowMissingColumns=True)


#: Passages that are looked for one by one at most.
FEW = 10_000


def holding(docs: DataFrame, items: DataFrame, few: int = FEW, key: str | None = None) -> DataFrame:
    """docs: text and any columns; items: passage -> the documents whose text holds a passage. A null holds nothing.

    Few passages are broadcast and looked for one by one. More are found by their rarest
    inner words (``passages``); those of one or two words, which have none, one by one in
    blocks of ``few``, each of which is broadcast. ``key``: a column with a value of its own
    in each row; without one, rows are numbered and written to the shared folder.
    """
    wanted = items.where(F.col("passage").isNotNull()).select("passage").distinct()
    if wanted.count() <= few:
        return docs.join(F.broadcast(wanted), F.contains("text", "passage"), "left_semi")
    names, own = docs.columns, key or "_row"
    if key is None:
        docs = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    inner = F.size(F.split("passage", " ")) >= 3
    found = passages.holding_rows(docs.select(own, "text"), materialize(wanted.where(inner), "passages"), own)
    short = materialize(wanted.where(~inner), "passages")
    blocks = -(-short.count() // max(few, 1))
    for i in range(blocks):
        block = short.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == i)
        found = found.unionByName(docs.join(F.broadcast(block), F.contains("text", "passage"), "left_semi").select(own))
    return docs.join(found.distinct(), own, "left_semi").select(*names)
