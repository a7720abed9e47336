"""Checks before a long run: of a dataset, of tokenizers, of feature shards and of a configuration.

A check is a condition on a row that should hold, with a severity: what breaks an ``error``
stops the run, a ``warning`` is told. All checks of a table are one aggregate, or are taken
in passing while the table is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    holds: Column
    severity: str = "error"

    def failures(self) -> Column:
        """Rows for which it doesn't hold; null doesn't."""
        return F.count_if(~F.coalesce(self.holds, F.lit(False)))


def dataset_checks(messages: str = "messages", mask: str = "loss_mask_segments") -> list[Check]:
    """What a training set must have; a sample with nothing to train on only gives an empty mask, which is a warning."""
    at = F.col(mask)["train_indices"]
    return [
        Check("has_messages", F.size(messages) > 0),
        Check("has_loss_mask_segments", F.col(mask).isNotNull()),
        Check("has_train_indices", at.isNotNull()),
        Check("has_nonzero_train_indices", F.size(at) > 0, "warning"),
        Check("indices_in_range", F.forall(at, lambda i: (i >= 0) & (i < F.size(messages)))),
    ]


def tokenizer_checks(target: Column, drafter: Column, max_length: int = 2048, alike: Column | None = None) -> list[Check]:
    """Of two tokenizers' identifiers of the same texts: both encode, alike, and within the length that is trained on.

    Alike are equal identifiers, unless ``alike`` says what is asked for.
    """
    return [
        Check("target_encodes", F.size(target) > 0),
        Check("drafter_encodes", F.size(drafter) > 0),
        Check("vocab_compatible", target == drafter if alike is None else alike, "warning"),
        Check("within_max_length", F.size(drafter) < max_length, "warning"),
    ]


def feature_checks(features: str, hidden: int) -> list[Check]:
    """Of feature rows, arrays of vectors: none is empty, and vectors are as wide as the model is."""
    return [
        Check("features_exist", F.size(features) > 0, "warning"),
        Check("hidden_dim_match", F.forall(features, lambda v: F.size(v) == hidden)),
    ]


def config_checks(config: DataFrame) -> list[Check]:
    """Of a model's configuration, one row: it names its sizes."""
    named = lambda c: F.col(c) > 0 if c in config.columns else F.lit(False)
    return [Check(f"config_{c}", named(c)) for c in ("hidden_size", "num_hidden_layers")]


def _report(name: str, severity: str, failed: Column, rows: Column) -> Column:
    """An error fails where a row does, or where there are no rows at all; a warning never fails."""
    bad = (failed > 0) | (rows == 0)
    status = F.when(~bad, "passed").otherwise("failed" if severity == "error" else "warned")
    return F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), failed.alias("failed"), rows.alias("rows"), status.alias("status"))


def report(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """check, severity, failed and rows (counts), status (passed, warned, failed), from one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[c.failures().alias(f"c{i}") for i, c in enumerate(checks)])
    made = F.array(*[_report(c.name, c.severity, F.col(f"c{i}"), F.col("n")) for i, c in enumerate(checks)])
    return counts.select(F.inline(made))


def ready(found: DataFrame) -> bool:
    """Whether a run may start: no check has failed."""
    return found.where("status = 'failed'").isEmpty()


def write_checked(rows: DataFrame, checks: list[Check], path: str, fmt: str = "parquet") -> DataFrame:
    """Write the rows, and report on them from counts taken in the same job."""
    seen = Observation("preflight")
    rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.failures().alias(f"c{i}") for i, c in enumerate(checks)]).write.mode("errorifexists").format(fmt).save(path)
    got = seen.get
    made = F.array(*[_report(c.name, c.severity, F.lit(got[f"c{i}"]), F.lit(got["n"])) for i, c in enumerate(checks)])
    return rows.sparkSession.range(1).select(F.inline(made))
