"""Tables that operators write for themselves, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders that queries outside any run of their own have had written, in order, for release().
_SHARED: list[str] = []
_RUN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("run", default=None)
#: Tables of the catalogue whose files are in a folder.
CATALOGUED: dict[str, str] = {}


def made() -> list[str]:
    """The folders written so far, in order: of this run, if it has tables of its own."""
    own = _RUN.get()
    return _SHARED if own is None else own


@contextlib.contextmanager
def own_tables() -> Iterator[list[str]]:
    """Within it, what is written belongs to one run: release() leaves the tables of all others alone."""
    token = _RUN.set([])
    try:
        yield made()
    finally:
        _RUN.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + (made := tempfile.mkdtemp(prefix="chatloom-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    made().append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.option("compression", compression).parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it lives, and the catalogue's table of it."""
    if name := CATALOGUED.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that have ended; else they stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Remove the tables written after the first ``since``, but for those in ``keep``. Results not read by then can't be read after."""
    kept = set(keep)
    for path in made()[since:]:
        if path not in kept:
            delete(spark, path)
            made().remove(path)
