"""Tables of an evaluation and of training, as a command writes them or a plot is drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import evaluation, metrics, series

#: What ``evaluate`` reads: history has the tokens that each pass accepted.
SAMPLES = "method string, prompt_no int, accepted double, passes int, tokens double, seconds double, output string, history array<int>"


def evaluation_tables(samples: DataFrame, baseline: str | None = None, heads: int = 4) -> dict[str, DataFrame]:
    """totals, heads (acceptance by position, in per cent) and speedup_series; with a baseline also speedup and lossless."""
    passes = samples.select("method", F.explode("history").alias("accepted"))
    rates = metrics.head_acceptance(passes, heads, by=["method"])
    out = {
        "totals": evaluation.method_totals(samples),
        "heads": rates.select("method", F.col("pos"), F.concat(F.lit("Head "), "pos").alias("head"), (F.col("rate") * 100).alias("percent")),
        "speedup_series": evaluation.speed_up_series(samples),
    }
    if baseline:
        out |= {"speedup": evaluation.speed_up(samples, baseline), "lossless": evaluation.lossless(samples, baseline)}
    return out


def training_tables(scalars: DataFrame, window: int = 10, rows: int = series.ROWS) -> dict[str, DataFrame]:
    """scalars: run, tag, step, value -> curve (each series with its smoothed values) and summary, of all runs and tags at once."""
    by = ["run", "tag"]
    curve = metrics.smooth(scalars.select(*by, "step", "value"), by, ["step"], window=window, rows=rows)
    summary = metrics.series_summary(scalars, by)
    last = scalars.groupBy(*by).agg(F.max_by("value", "step").alias("final"), (F.max(F.abs("value")) == 0).alias("all_zero"))
    return {"curve": curve, "summary": summary.join(last, by)}


def comparison_table(a: DataFrame, b: DataFrame, method: str) -> DataFrame:
    """metric, model1, model2: totals and acceptance by head of one method in two evaluations; what one lacks is 0."""
    def flat(samples: DataFrame) -> DataFrame:
        tables = evaluation_tables(samples.where(F.col("method") == method))
        totals = tables["totals"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mean_mal", "mean_tps", "overall_tps")])))
        return totals.unionByName(tables["heads"].select(F.col("head").alias("metric"), F.col("percent").alias("value")))

    return metrics.compare(flat(a), flat(b), "metric", "value")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("errorifexists").json(f"{path}/{name}")
