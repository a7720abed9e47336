"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.tables import CATALOGUED, delete, free, fresh_path, made, materialize, own_tables, release, shared_dir

__all__ = ["CATALOGUED", "delete", "free", "fresh_path", "made", "materialize", "own_tables", "release", "shared_dir"]

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def pack(df: DataFrame, **named: str) -> DataFrame:
    """One column _row that holds a row's columns, whatever their names, and those that an operator works on by its own names."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("_row")
    return df.select(row, *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def unpack(df: DataFrame, **added: Column | str) -> DataFrame:
    """The columns in _row, and those added, which take the place of columns of their names."""
    new = {n: F.col(c) if isinstance(c, str) else c for n, c in added.items()}
    names = df.schema["_row"].dataType.names
    kept = [new.pop(n).alias(n) if n in new else F.col("_row").getField(n).alias(n) for n in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def words_of(text: Column) -> Column:
    """The text's words, array<string>: runs of anything but BLANKS; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without building them: a word starts where a non-blank follows a blank or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
