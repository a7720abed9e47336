"""Analytics of decoding, training and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.schemas import LORA_TARGETS
from chatloom.operators import series


def head_acceptance(history: DataFrame, k: int, accepted: str = "accepted", by: list[str] | None = None) -> DataFrame:
    """Share of passes that accept ``pos`` tokens or more, for pos from 1 to k."""
    by = by or []
    rates = [F.coalesce(F.avg((F.col(accepted) >= p).cast("double")), F.lit(0.0)) for p in range(1, k + 1)]
    wide = history.groupBy(*by).agg(F.array(*[F.struct(F.lit(p).alias("pos"), r.alias("rate")) for p, r in zip(range(1, k + 1), rates, strict=True)]).alias("r"))
    return wide.select(*by, F.explode("r").alias("x")).select(*by, "x.pos", "x.rate")


def generation(accepted: Column, passes: Column, drafted: Column, tokens: Column, seconds: Column, mal: Column) -> dict[str, Column]:
    return {
        "mal": F.coalesce(mal, F.lit(0.0)),
        "speedup": F.when(passes > 0, accepted / passes).otherwise(F.lit(1.0)),
        "acceptance_rate": accepted / F.greatest(drafted, F.lit(1)),
        "tokens_per_second": tokens / F.greatest(seconds, F.lit(0.001)),
    }


def cumulative_history(samples: DataFrame, run: str, order: str, accepted: str, compat: bool = False, rows: int = series.ROWS) -> DataFrame:
    """Mean acceptance length of each prompt; with ``compat`` over all prompts so far, as a history that is never reset."""
    per = samples.groupBy(run, order).agg(F.sum(accepted).alias("s"), F.count(accepted).alias("n"))
    if compat:
        per = series.running(series.laid_out(per, [run], [order], rows), [run], s=("sum", F.col("s")), n=("sum", F.col("n")))
    return per.select(run, order, F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("mal"))


def series_summary(points: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return points.groupBy(*by).agg(zero(F.avg(value)).alias("mean"), zero(F.stddev_pop(value)).alias("std"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"), F.count(value).alias("count"))


def smooth(points: DataFrame, by: list[str], order: list[str], value: str = "value", window: int = 10, rows: int = series.ROWS) -> DataFrame:
    """Centred moving mean of window // 2 points to either side; series shorter than the window stay as they are."""
    half = window // 2
    counted = series.with_totals(series.laid_out(points, by, order, rows), by, _n=F.count(F.lit(1)))
    made = series.moving(counted, by, half, half, rows, _mean=F.avg(value))
    return made.withColumn("smoothed", F.when(F.col("_n") < window, F.col(value)).otherwise(F.col("_mean"))).drop("_n", "_mean", "_ord", "_block")


def trailing_mean(points: DataFrame, by: list[str], order: list[str], value: str = "value", window: int = 100) -> DataFrame:
    """Mean of the last ``window`` points, by their numbers in the order of all series: no window over a series."""
    last = series.with_totals(series.laid_out(points, by, order), by, _last=F.max("_ord")).where(F.col("_ord") > F.col("_last") - window)
    return last.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def early_stopping(epochs: DataFrame, run: list[str], order: str, val: str, train: str, patience: int = 5, overfit: float = 1.5, rows: int = series.ROWS) -> DataFrame:
    """``improved`` (strictly below the best so far), ``misses`` in a row, ``stopped`` (after ``patience`` misses with
    validation), ``overfit``. Without validation the training loss decides, and never stops."""
    laid = series.laid_out(epochs.withColumn("watched", F.coalesce(val, train)), run, [order], rows)
    e = series.running(laid, run, exclusive=True, _best=("min", F.col("watched")))
    e = e.withColumn("improved", F.col("_best").isNull() | (F.col("watched") < F.col("_best"))).drop("_best")
    e = series.running(e, run, _since=("max", F.when(F.col("improved"), F.col("_ord"))))
    e = e.withColumn("misses", (F.col("_ord") - F.col("_since")).cast("int"))
    e = series.with_totals(e, run, _stop=F.min(F.when((F.col("misses") >= patience) & F.col(val).isNotNull(), F.col("_ord"))))
    e = e.withColumns({"stopped": F.coalesce(F.col("_ord") >= F.col("_stop"), F.lit(False)), "overfit": F.coalesce(F.col(val) > overfit * F.col(train), F.lit(False))})
    return e.drop("watched", "_since", "_stop", "_ord", "_block")


def accepted_prefix(steps: DataFrame, step: list[str], pos: str = "pos", least: float = 0.8) -> DataFrame:
    """Tokens that verification gives: drafts up to the first that fails, and the target's token in its place.

    A draft passes if it equals the target or has ``least`` of the target's probability.
    """
    ok = (F.col("draft") == F.col("target")) | (F.col("draft_prob") >= least * F.col("target_prob"))
    bad = F.min(F.when(~ok, F.col(pos))).over(Window.partitionBy(*step))
    out = steps.withColumn("_bad", bad).where(F.col("_bad").isNull() | (F.col(pos) <= F.col("_bad")))
    return out.withColumn("token", F.when(F.col(pos) == F.col("_bad"), F.col("target")).otherwise(F.col("draft"))).drop("_bad")


def nucleus(probs: DataFrame, by: list[str], prob: str = "prob", tie: str = "token", p: float = 0.9) -> DataFrame:
    """Tokens kept by top-p: those whose predecessors, by falling probability, sum to p or less; the first always."""
    w = Window.partitionBy(*by).orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(prob).over(w)
    return probs.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") <= p)).drop("_before")


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs side by side, a missing metric as 0."""
    joined = a.select(key, F.col(value).alias("model1")).join(b.select(key, F.col(value).alias("model2")), key, "full_outer")
    return joined.select(key, F.coalesce("model1", F.lit(0.0)).alias("model1"), F.coalesce("model2", F.lit(0.0)).alias("model2"))


def validation_loss(errors: DataFrame) -> DataFrame:
    """batch, head, error, mask (per token) -> mean over batches of the mean over heads; heads without a number are left out."""
    heads = errors.groupBy("batch", "head").agg((F.sum(F.col("error") * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("loss"))
    per = heads.where(~F.isnan("loss")).groupBy("batch").agg(F.avg("loss").alias("loss"))
    return per.agg(F.avg("loss").alias("loss"))


def sampled_steps(points: DataFrame, every: int = 10, step: str = "step") -> DataFrame:
    return points.where(F.col(step) % every == 0)


def mismatches(a: DataFrame, b: DataFrame, key: str = "phrase", value: str = "ids") -> DataFrame:
    """Number of phrases that two tokenizers encode unlike."""
    x = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return x.agg(F.count_if(F.col("x") != F.col("y")).alias("mismatches"), F.count(F.lit(1)).alias("phrases"))


def same_output(a: Column, b: Column) -> Column:
    return F.avg((F.trim(a) == F.trim(b)).cast("double"))


def step_loss(heads: DataFrame, by: list[str], weight: float = 0.1) -> DataFrame:
    """Per step: mean of the heads' KL, plus a tenth of the mean of their squared errors."""
    return heads.groupBy(*by).agg((F.avg("kl") + weight * F.avg("mse")).alias("loss"))


def epoch_means(steps: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    return steps.groupBy(*by).agg(F.avg(loss).alias("loss"))


def lora_targets(modules: DataFrame, suffixes: tuple[str, ...] = LORA_TARGETS, name: str = "module") -> DataFrame:
    """Targets that some module's name is, or ends in after a dot, in the given order; the query and value projections if
    there are none."""
    hit = [F.max((F.endswith(name, F.lit(f".{s}")) | (F.col(name) == s)).cast("int")) == 1 for s in suffixes]
    found = F.filter(F.array(*[F.when(h, F.lit(s)) for h, s in zip(hit, suffixes, strict=True)]), lambda x: x.isNotNull())
    return modules.agg(found.alias("t")).select(F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit("q_proj"), F.lit("v_proj")))).alias("target"))


# estimates


def vram(params_b: Column, hidden: Column, batch: Column, seq: int = 2048, depth: int = 4, lora: bool = True) -> dict[str, Column]:
    """Gigabytes of memory that training takes, by part, rounded half to even."""
    base = params_b * (2 if lora else 4)
    adapters = base * 0.01 if lora else F.lit(0.0)
    gradients, optimizer = (adapters, adapters * 2) if lora else (base, base * 2)
    layers = F.when(params_b >= 1.5, 24).otherwise(16)
    gib = float(1024**3)
    activations = (batch * seq * 2048 * layers * 4) / gib
    heads = (depth * batch * seq * hidden * 4) / gib
    cache = (batch * seq * hidden * 4) / gib
    parts = {"base_model_gb": base, "lora_params_gb": adapters, "gradients_gb": gradients, "optimizer_states_gb": optimizer, "activations_gb": activations, "mtp_heads_gb": heads, "feature_cache_gb": cache, "overhead_gb": F.lit(2.0)}
    total = F.lit(0.0)
    for p in parts.values():
        total = total + p
    return {k: F.bround(v, 2) for k, v in (parts | {"total_required_gb": total, "recommended_gb": total * 1.2}).items()}


def training_time(samples: Column, epochs: Column, batch: Column, per_second: float = 1.5) -> dict[str, Column]:
    steps = F.ceil(samples / batch)
    return {"steps_per_epoch": steps, "total_steps": steps * epochs, "total_seconds": steps * epochs / per_second}


# tables that plots are drawn from


def training_curve(points: DataFrame, run: str = "run", rows: int = series.ROWS) -> DataFrame:
    """Loss by step with its smoothed curve, final and least value, and whether all are 0."""
    s = smooth(points, [run], ["step"], rows=rows)
    return series.with_totals(s, [run], final=F.max_by("value", "step"), least=F.min("value"), all_zero=F.max(F.abs("value")) == 0)


def acceptance_bars(rates: DataFrame) -> DataFrame:
    return rates.select(F.concat(F.lit("Head "), F.col("pos")).alias("head"), (F.col("rate") * 100).alias("percent"))
