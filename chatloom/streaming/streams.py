"""Structured Streaming forms of the operators, and event-time windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.operators.seen import SeenSet, listed, resume_batch
from chatloom.operators.tables import fresh_path


def read_json(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def distinct(rows: DataFrame, key: str, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Rows whose key hasn't come before. Without a delay the state holds every key for good; with one, repeats that come
    later than ``delay`` after the first are let through."""
    return rows.dropDuplicates([key]) if delay is None else rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def resume_into(rows: DataFrame, path: str, key: str, checkpoint: str, bits: int = 8) -> StreamingQuery:
    """Append rows whose key the Parquet sink doesn't hold yet; a batch that runs again adds nothing.

    What the sink holds is in a stored set beside it, ``<path>-seen``, of which a batch reads
    what its keys touch. A sink that is older than its set is read once, for its keys. One
    stream writes to a sink at a time; each has a checkpoint of its own.
    """
    spark = rows.sparkSession
    seen = SeenSet(spark, f"{path.rstrip('/')}-seen", bits)
    if not seen.commits() and any(n.endswith(".parquet") for n in listed(spark, path)):
        seen.commit(spark.read.parquet(path).select(key), "earlier")
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        resume_batch(SeenSet(batch.sparkSession, seen.path, bits), batch, key, path, f"{stream}-{number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(rows: DataFrame, ts: str, size: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if rows.isStreaming else timed
    return timed.groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, ts: str, gap: str, by: list[str], delay: str = "10 minutes") -> DataFrame:
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, delay) if rows.isStreaming else timed
    return timed.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def running_mean(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of all values of a key so far: a history that grows with the stream."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def drain(rows: DataFrame, name: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what there is now and return the result as a table in the shared folder, where its checkpoint is too.

    A batch that runs again writes over its own folder. In mode ``complete`` the last batch holds the whole result.
    """
    spark = rows.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    stream = transform(rows) if transform else rows
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={n}" for n in (written[-1:] if mode == "complete" else sorted(set(written)))]
    return spark.read.schema(stream.schema).parquet(*paths)
