"""Shards of even size in bytes, however uneven rows are, with a manifest, committed as a whole and read back in order.

    <path>/shard=<n>/part-*   the rows of a shard, in order
    <path>/_manifest          shard, rows, bytes, first and last number of its rows

Readers take no notice of a folder without a manifest, which is moved into place last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import series
from chatloom.operators.seen import listed
from chatloom.operators.tables import delete, fresh_path

MANIFEST = "shard int, rows long, bytes long, first_ord long, last_ord long"


def json_bytes(rows: DataFrame) -> Column:
    """Bytes of a row as JSON: about what it takes, whatever its columns are."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).cast("long")


def write_balanced(rows: DataFrame, path: str, order: list[str], target: int, size: Column | None = None, block: int = series.ROWS) -> DataFrame:
    """Write the rows, in a unique order, to shards of about ``target`` bytes; gives the manifest.

    A row begins a new shard where the bytes before it pass a multiple of ``target``, so a
    shard is over it by less than one row. Bytes before a row are a scan in two levels; no
    shard depends on another, and a row larger than the target has a shard of its own.
    """
    spark = rows.sparkSession
    if listed(spark, path):
        raise FileExistsError(path)
    sized = rows.withColumn("_bytes", json_bytes(rows) if size is None else size)
    before = series.running(series.laid_out(sized, [], order, block), [], exclusive=True, _before=("sum", F.col("_bytes")))
    placed = before.withColumn("shard", F.floor(F.coalesce("_before", F.lit(0)) / target).cast("int")).drop("_before", "_block")
    staged = fresh_path(spark, "shards")
    placed.repartition("shard").sortWithinPartitions("shard", "_ord").write.partitionBy("shard").parquet(f"{staged}/data")
    made = spark.read.parquet(f"{staged}/data").groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"), F.min("_ord").alias("first_ord"), F.max("_ord").alias("last_ord"))
    made.repartition(1).sortWithinPartitions("shard").write.parquet(f"{staged}/manifest")
    move(spark, f"{staged}/data", path)
    move(spark, f"{staged}/manifest", f"{path}/_manifest")
    delete(spark, staged)
    return manifest(spark, path)


def move(spark: SparkSession, source: str, to: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path
    fs = where(to).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if (parent := where(to).getParent()) is not None:
        fs.mkdirs(parent)
    if not fs.rename(where(source), where(to)):
        raise OSError(f"can't move {source} to {to}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if "_manifest" not in listed(spark, path):
        raise FileNotFoundError(f"{path} has no manifest: it wasn't written to the end")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read_shards(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Rows of shards ``first`` to ``last`` (all, by default), with shard and ord, their number from 1 in the whole order."""
    manifest(spark, path)
    rows = spark.read.parquet(path).withColumnRenamed("_ord", "ord").drop("_bytes")
    return rows.where(F.col("shard") >= first if last is None else F.col("shard").between(first, last))
