"""Quotas, seeded order, splits, paging and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.selection import fill_to, take_first
from chatloom.operators.tables import materialize


def seeded(key: Column, seed: int = 42) -> Column:
    """A reproducible random order that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def parse_ratios(spec: str) -> dict[str, float]:
    """``name:share,name:share``, made to sum to 1 if they don't nearly."""
    pairs = [p.split(":") for p in spec.split(",") if p.strip()]
    ratios = {k.strip(): float(v) for k, v in pairs}
    total = sum(ratios.values())
    return {k: v / total for k, v in ratios.items()} if abs(total - 1) > 0.01 else ratios


def shuffled_limit(rows: DataFrame, n: int, key: str = "doc_id", seed: int | None = 42) -> DataFrame:
    """n rows in the order of a hash of seed and key; without a seed, in an order that differs from run to run."""
    if seed is None:
        return rows.orderBy(F.rand()).limit(n)
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)


def global_rank(rows: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """Dense row number, from 1, over a total order, without bringing all rows to one task.

    Rows are dealt over ranges of the order, and the dealing is written to the shared
    folder: ranges are drawn by a sample, so a lost part of it couldn't be made again. Rows
    are numbered within ranges; the ranges' sizes, one number each, are summed up on the driver.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_k", F.struct(*order)).repartitionByRange(spark.sparkContext.defaultParallelism * 4, "_k")
    dealt = materialize(dealt.withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = {r[0]: r[1] for r in dealt.groupBy("_p").count().collect()}
    before, base = 0, []
    for p in sorted(sizes):
        base.append((p, before))
        before += sizes[p]
    start = F.create_map(*[x for p, b in base for x in (F.lit(p), F.lit(b))]) if base else F.create_map().cast("map<int,int>")
    w = Window.partitionBy("_p").orderBy("_k")
    return dealt.withColumn(name, (F.row_number().over(w) + start[F.col("_p")]).cast("long")).drop("_p", "_k")


def quota_sample(rows: DataFrame, ratios: dict[str, float], n: int, source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Each source's first int(n * ratio) rows in seeded order; all its rows, if it has fewer.

    Histograms of the hash find the last hash that each source takes; the rows are then one
    filtered scan, without a sort or a shuffle.
    """
    return take_first(rows, source, seeded(F.col(key), seed), key, {name: int(n * ratio) for name, ratio in ratios.items()})


def split(rows: DataFrame, share: float = 0.8, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``part``: exactly int(share * n) rows ``train``, the rest ``val``."""
    n = rows.count()
    ranked = global_rank(rows, [seeded(F.col(key), seed), F.col(key)], "_ord")
    return ranked.withColumn("part", F.when(F.col("_ord") <= int(share * n), "train").otherwise("val")).drop("_ord")


def page(rows: DataFrame, cursor: int, size: int, order: str = "ord") -> DataFrame:
    """The next ``size`` valid rows after a cursor over a dense order, which doesn't move however often it is asked."""
    return rows.where((F.col(order) > cursor) & (F.col(order) <= cursor + size))


def shards(rows: DataFrame, size: int, order: str = "ord") -> DataFrame:
    return rows.withColumn("shard", F.floor((F.col(order) - 1) / size).cast("int"))


def refill(rows: DataFrame, keep: Column, target: int, order: str) -> DataFrame:
    """The first ``target`` rows that pass, in order; rows beyond those that it takes are never tried."""
    return fill_to(rows, keep, target, order).rows
