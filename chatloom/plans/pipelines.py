"""Whole runs, each one lazy plan: distilling logs and generating a dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.schemas import LOG, MESSAGES
from chatloom.operators import conversations as V
from chatloom.operators import dedup, masks, sampling, secrets


@dataclass(frozen=True)
class Distill:
    target: int | None = 1000
    min_response: int = 30
    deduplicate: bool = True
    check_code: bool = False
    scan_secrets: bool = True
    stop_on_secret: bool = False
    mask_secrets: bool = True


def staged(logs: DataFrame, o: Distill = Distill()) -> DataFrame:
    """logs: ord, source and the columns of LOG -> messages as distilled, and drop_reason, the first stage that fails."""
    rows = logs.withColumn("messages", V.log_messages(F.col("conversation"), F.col("response")))
    empty = F.size("messages") == 0
    rows = rows.withColumn("_empty", empty).withColumn("messages", V.with_system("messages", F.col("source") == "local"))
    rows = rows.withColumn("messages", V.without_fillers("messages", V.fillers(V.first_of("messages", "system"))))
    tests = [
        ("status", ~V.status_ok(F.col("type"))),
        ("empty", F.col("_empty")),
        ("error_content", ~V.no_error_content("messages")),
        ("tool_error", ~V.tools_intact("messages")),
    ]
    if o.check_code:
        tests.append(("no_code", ~V.code_answered("messages")))
    tests.append(("too_short", ~V.long_enough("messages", o.min_response)))
    if o.scan_secrets and (o.mask_secrets or o.stop_on_secret):
        clean = F.transform("messages", lambda m: F.struct(m.role.alias("role"), secrets.mask_tokens(m.content).alias("content"), m.tool_calls.alias("tool_calls"))).cast(MESSAGES)
        rows = rows.withColumn("_masked", clean)
        if o.stop_on_secret:
            tests.append(("secret", F.to_json("_masked") != F.to_json("messages")))
    rows = rows.withColumn("drop_reason", V.first_reason(tests))
    if "_masked" in rows.columns:
        rows = rows.withColumn("messages", F.col("_masked") if o.mask_secrets else F.col("messages")).drop("_masked")
    return rows.drop("_empty")


def distill(logs: DataFrame, o: Distill = Distill()) -> DataFrame:
    """The kept samples, first by ord, with their loss masks."""
    kept = staged(logs, o).where("drop_reason is null")
    if o.deduplicate:
        kept = dedup.keep_first(kept, dedup.user_hash("messages"), "ord")
    kept = kept.withColumn("loss_mask_segments", masks.loss_mask("messages"))
    return kept.orderBy("ord").limit(o.target) if o.target else kept


def drop_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def generate(rows: DataFrame, n: int, ratios: dict[str, float] | None = None, prior: DataFrame | None = None, min_words: int = 0, deduplicate: bool = True, seed: int = 42) -> DataFrame:
    """rows: ord, source, messages -> a mixed, deduplicated, masked dataset of n samples at most.

    Limits come before the word filter, so the result can have fewer rows.
    """
    kept = V.clean(rows).where("drop_reason is null")
    if ratios:
        kept = sampling.quota_sample(kept, ratios, n, key="ord", seed=seed)
    if deduplicate:
        kept = dedup.keep_first(kept, dedup.sample_hash("messages"), "ord")
    if prior is not None:
        kept = dedup.resume(prior.withColumn("h", dedup.sample_hash("messages")), kept.withColumn("h", dedup.sample_hash("messages"))).drop("h")
    kept = kept.orderBy("ord").limit(n).where(V.enough_words("messages", min_words))
    return kept.withColumn("loss_mask_segments", masks.loss_mask("messages"))


__all__ = ["LOG", "Distill", "distill", "drop_counts", "generate", "staged"]
