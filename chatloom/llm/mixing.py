"""Mixing sources to target weights by hash-threshold histograms, without a sort.

Every row has a 60-bit hash of its id and text. Token counts are summed by source and the top
bits of the hash; where a source's running sum crosses its budget lies the boundary
bucket, and only that bucket is summed again by the next bits, until it holds one hash
value. A row is taken when its hash lies below its source's threshold. As thresholds
of larger budgets are larger, the selections are nested.

Cases: a null text has size 0, a null source is a source of its own, rows of size 0 are
taken or left by their hash like others. Rows with equal ids and texts share a hash, and
are taken or left together; a null id or text hashes like an empty one. An empty table
gives no rows. Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import count_words, materialize, unpack
from chatloom.operators.sampling import global_rank
from chatloom.operators.skew import salted_join

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A row is repeated so many times at most.
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12
#: Tables of so many sources at most are broadcast, larger ones joined by a salted shuffle.
BROADCAST_SOURCES = 100_000


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text as a long, so that SQL engines agree on it."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source as a string that is never null, so that a null source joins too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """sizes: source, source_size -> with target: ``share`` of all tokens dealt by weight, none above MOST_REPEATS
    times its source's size.

    Sources stand in code-point order, null last. The excess over the caps is dealt again
    among the others until none is above its cap; a pass is one aggregate over the
    sources, of which the driver sees three sums, exact integers. Every pass but the last
    caps a source, and the level that it shares grows; the number of passes follows the
    spread of cap / weight, not the number of sources.
    """
    ranked = global_rank(sizes, [F.col("source").isNull(), F.col("source").cast("binary")], "_rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    big = "decimal(38,0)"
    s = materialize(ranked.select("source", "source_size", w.cast(big).alias("w"), (F.col("source_size") * MOST_REPEATS).cast(big).alias("cap")), "mix-ranked")
    total = int((s.agg(F.sum("source_size")).first()[0] or 0) * share)
    capped, before = F.lit(False), -1
    while True:
        n, caps, rest_w = s.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        rest, rest_w = F.lit(total - int(caps or 0)).cast(big), int(rest_w or 0)
        level = (rest * F.col("w")).cast("double") / F.lit(float(rest_w)) if rest_w else F.lit(None).cast("double")
        if n == before:
            return s.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(level).alias("target"))
        # capped: the level that the sources not capped so far would share is at this one's cap or above
        before, capped = n, F.col("cap") * F.lit(rest_w).cast(big) <= rest * F.col("w")


def join_sources(rows: DataFrame, side: DataFrame, sources: int) -> DataFrame:
    """rows and side (few rows a source, on key ``k``): broadcast up to BROADCAST_SOURCES, else by a salted shuffle."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(side), "k")
    return salted_join(rows, side, "k", F.col("h"), "inner")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: source, h, size. budgets: source, name, budget -> source, name, threshold: the rows with h < threshold
    have the sum of sizes nearest to the budget (the smaller sum of two as near).

    Each level reads the histogram of one bucket per source and budget; the driver sees
    none of it. A level's histogram has 2^LEVEL_BITS rows per source and budget at most.
    """
    whole = F.lit(0).cast("decimal(38,0)")
    rows = rows.select(source_key(F.col("source")).alias("k"), "h", "size")
    state = budgets.select(source_key(F.col("source")).alias("k"), "source", "name", "budget", F.lit(0).cast("long").alias("low"), whole.alias("sum_low"), whole.alias("in_bucket"))
    state = materialize(state, "mix-budgets")
    n = state.count()
    bits = HASH_BITS
    while bits > 0:
        span, bits = bits, bits - LEVEL_BITS
        bucket = F.shiftright("h", bits).alias("bucket")
        sums = [F.sum("size").cast("decimal(38,0)").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1")]
        if span == HASH_BITS:  # the first histogram is the same for all budgets of a source
            hist = rows.groupBy("k", bucket).agg(*sums)
            hist = hist.join(F.broadcast(state), "k") if n <= BROADCAST_SOURCES else hist.join(state, "k")
        else:
            side = state.groupBy("k").agg(F.collect_list(F.struct(*[c for c in state.columns if c != "k"])).alias("b"))
            at = F.shiftright("h", span) == F.shiftright("b.low", span)
            inside = join_sources(rows, side, n).select("k", "h", "size", F.explode("b").alias("b")).where(at)
            hist = inside.groupBy("k", *[F.col(f"b.{c}").alias(c) for c in state.columns if c != "k"], bucket).agg(*sums)
        run = Window.partitionBy("k", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("sum_low") + F.sum("n").over(run))
        at = F.struct("bucket", "upto", "n", "h0", "h1")
        crossing = F.min_by(at, F.when(F.col("upto") >= F.col("budget"), F.col("bucket")))
        found = hist.groupBy("k", "source", "name", "budget").agg(F.coalesce(crossing, F.max_by(at, F.col("bucket"))).alias("x"))
        one = F.col("x.h0") == F.col("x.h1")
        state = materialize(
            found.select(
                "k",
                "source",
                "name",
                "budget",
                F.when(one, F.col("x.h0")).otherwise(F.shiftleft(F.col("x.bucket"), bits)).alias("low"),
                (F.col("x.upto") - F.col("x.n")).cast("decimal(38,0)").alias("sum_low"),
                F.col("x.n").alias("in_bucket"),
                one.alias("one"),
            ),
            "mix-level",
        )
        done = state.where(~F.col("one")).isEmpty()
        state = state.drop("one")
        if done:  # every boundary bucket holds one hash value
            break
    over, under = F.col("sum_low") + F.col("in_bucket") - F.col("budget"), F.col("budget") - F.col("sum_low")
    return state.select("k", "source", "name", (F.col("low") + F.when(over < under, 1).otherwise(0)).alias("threshold"))


def mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = 1.0, size: Column | None = None) -> DataFrame:
    """Add _size, _source_size, _target and _times (how often the mix takes the row, 0 to MOST_REPEATS) to documents.

    Sizes and hashes are read twice: once into a table of (source, hash, size), once as the result.
    """
    size = count_words(F.col("text")) if size is None else size
    hashed = row_hash(F.col(key), F.col("text"))
    rows = materialize(docs.select("source", hashed.alias("h"), size.alias("size")), "mix-rows")
    plan = mix_plan(rows, weights, share)
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row")
    taken = join_plan(docs.select(row, "source", hashed.alias("h"), size.alias("_size")), plan)
    return unpack(taken, _size="_size", _source_size="_source_size", _target="_target", _times="_times")


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """rows: source, h, size -> one row per source: k, source_size, target, whole (full repeats), threshold."""
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    plan = targets(sizes, weights, share)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("int")
    plan = materialize(plan.withColumns({"whole": whole, "k": source_key(F.col("source"))}), "mix-plan")
    budgets = plan.select("source", F.lit("mix").alias("name"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    return materialize(plan.drop("source").join(thresholds(rows, budgets).select("k", "threshold"), "k"), "mix-thresholds")


def join_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows: source, h and others -> with _source_size, _target and _times; h goes."""
    p = plan.select("k", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), F.col("threshold").alias("_threshold"))
    joined = join_sources(rows.withColumn("k", source_key(F.col("source"))), p, plan.count())
    times = F.least(F.col("_whole") + F.when(F.col("h") < F.col("_threshold"), 1).otherwise(0), F.lit(MOST_REPEATS))
    return joined.withColumn("_times", times).drop("k", "h", "_whole", "_threshold")
