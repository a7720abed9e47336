"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import materialize
from chatloom.operators.skew import HOT_SHARE


#: A node with more edges than this, and with more than 1/HOT_SHARE of all, has its edges dealt over SALTS tasks.
HOT_EDGES, SALTS = 256, 64


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (``total`` of them, about) with m, the smallest b of each a.

    A partial aggregate and a join, not a window, which would bring a node's edges to one
    task. Nodes with very many edges are salted: fewer than HOT_SHARE of them, by construction.
    """
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    limit = max(HOT_EDGES, total // HOT_SHARE)
    hot = [r.a for r in least.where(F.col("n") > limit).select("a").collect()] if total > limit else []
    least = least.drop("n")
    if not hot:
        return edges.join(least, "a")
    is_hot = F.col("a").isin(hot)
    left = edges.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0))
    right = least.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, label: the smallest node that it reaches. Nodes without an edge don't occur.

    Large-star and small-star steps in turn, which end in a star around each smallest
    node after a number of rounds that grows with the logarithm of the graph. Every
    round is written to the shared folder; the driver sees two numbers a round.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, total = None, edges.count()
    while True:
        # large star: every larger neighbour links to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # small star: smaller neighbours, and the node itself, link to the smallest of them
        small = with_least(large, total).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))).first()
        if now == mark or not now[0]:
            break
        mark, total = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
