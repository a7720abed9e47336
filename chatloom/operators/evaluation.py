"""Evaluation of decoding: speed against a baseline, acceptance, losslessness, and the tables of the usual plots.

samples: method, prompt_no, accepted (tokens), passes, tokens, seconds, output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def speed(tokens: str = "tokens", seconds: str = "seconds") -> Column:
    return F.try_divide(F.col(tokens).cast("double"), F.col(seconds).cast("double"))


def method_totals(samples: DataFrame) -> DataFrame:
    """method, samples, mean_mal (mean of accepted by pass), mean_tps (of samples), overall_tps (all tokens by all seconds)."""
    mal = F.coalesce(F.try_divide(F.col("accepted").cast("double"), F.col("passes").cast("double")), F.lit(0.0))
    return samples.groupBy("method").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(mal).alias("mean_mal"), F.avg(speed()).alias("mean_tps"),
        F.try_divide(F.sum(F.col("tokens").cast("double")), F.sum(F.col("seconds").cast("double"))).alias("overall_tps"),
    )


def speed_up(samples: DataFrame, baseline: str) -> DataFrame:
    """method, speedup: the mean speed of its samples by the baseline's overall speed; 1 where the baseline has none."""
    totals = method_totals(samples)
    base = totals.where(F.col("method") == baseline).agg(F.max("overall_tps")).first()[0]
    others = totals.where(F.col("method") != baseline)
    return others.select("method", (F.col("mean_tps") / base if base else F.lit(1.0)).alias("speedup"))


def speed_up_series(samples: DataFrame) -> DataFrame:
    """method, prompt_no, speedup of each sample over one token a pass, and the method's mean beside it."""
    each = samples.select("method", "prompt_no", F.when(F.col("passes") > 0, F.col("accepted") / F.col("passes")).otherwise(0.0).alias("speedup"))
    means = each.groupBy("method").agg(F.avg("speedup").alias("mean"))
    return each.join(means, "method")


def lossless(samples: DataFrame, baseline: str) -> DataFrame:
    """method, verified, total, match_rate: prompts whose output, blanks at the ends aside, is the baseline's."""
    theirs = samples.where(F.col("method") == baseline).groupBy("prompt_no").agg(F.min("output").alias("_base"))
    both = samples.where(F.col("method") != baseline).join(theirs, "prompt_no")
    same = F.trim("output") == F.trim("_base")
    return both.groupBy("method").agg(F.count_if(same).alias("verified"), F.count(F.lit(1)).alias("total"), F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("match_rate"))
