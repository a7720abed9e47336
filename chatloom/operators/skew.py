"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys at any input size.
HOT_SHARE = 1000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: Column,
    how: str = "left",
    salts: int = 64,
) -> DataFrame:
    """Equi-join a large ``left`` with ``right`` (at most one row per key), splitting hot keys.

    Keys with more than ``1 / HOT_SHARE`` of ``left``'s rows are found by a partial
    aggregate (fewer than ``HOT_SHARE`` of them by construction, so the list of hot
    keys has a proven bound). Their left rows get a salt from ``row_id`` and the input
    partition they are in, so rows that share an id, or have none, spread too; a partition
    made again gives its rows the same salts. Their right rows are repeated once per salt;
    all other keys join as usual.
    Null keys match nothing: with ``how='left'`` they are kept, with nulls on the right.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    least = max(total // HOT_SHARE, 1000)
    hot = [r[0] for r in counts.where(F.col("_n") > least).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    salt = F.pmod(F.xxhash64(row_id, F.spark_partition_id()), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    spread = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(spread))
    return left.join(right, [key, "_salt"], how).drop("_salt")
