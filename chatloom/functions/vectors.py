"""Array mathematics on feature vectors, and masks. Heavy products run batched in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.bind import let


def add(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def scale(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * k)


def fuse(layers: list[Column], mode: str = "mean", weights: list[float] | None = None) -> Column:
    """Fuse layers' vectors: ``mean``, ``concat``, or ``weighted`` by the softmax of explicit weights."""
    if mode == "concat":
        return F.concat(*layers)

    def total(w: list[float]) -> Column:
        scaled = [v if k == 1 else scale(v, k) for v, k in zip(layers, w, strict=True)]
        out = scaled[0]
        for v in scaled[1:]:
            out = F.zip_with(out, v, lambda a, b: a + b)
        return out

    if mode == "mean":
        return scale(total([1.0] * len(layers)), 1 / len(layers))
    if mode == "weighted":
        if weights is None or len(weights) != len(layers):
            raise ValueError("weighted fusion needs a weight per layer")
        e = np.exp(np.array(weights) - max(weights))
        return total((e / e.sum()).tolist())
    raise ValueError(f"no fusion mode {mode!r}")


def softmax(v: Column, temperature: float = 1.0) -> Column:
    powers = lambda top: F.transform(v, lambda x: F.exp((x - top) / temperature))
    return let(let(F.array_max(v), powers), lambda e: let(add(e), lambda total: F.transform(e, lambda x: x / total)))


def log_softmax(v: Column, temperature: float = 1.0) -> Column:
    scaled = let(F.array_max(v), lambda top: F.transform(v, lambda x: (x - top) / temperature))
    return let(scaled, lambda z: let(F.ln(add(F.transform(z, F.exp))), lambda total: F.transform(z, lambda x: x - total)))


def argmax(v: Column) -> Column:
    """Position, from 0, of the first largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def kl_distillation(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """A row's KL(teacher || student) at a temperature, times its square; average over a batch."""
    p, q = softmax(teacher, temperature), log_softmax(student, temperature)
    return add(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.ln(a) - b)).otherwise(0.0))) * temperature**2


def squared_error(a: Column, b: Column) -> Column:
    return add(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def masked_mse(tokens: DataFrame, by: list[str], pred: str, target: str, mask: str, width: int) -> DataFrame:
    """Sum of mask * (p - t)^2 over mask * width; 0 where the mask is empty."""
    error = squared_error(F.col(pred), F.col(target)) * F.col(mask)
    return tokens.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(error), F.sum(mask) * width), F.lit(0.0)).alias("mse"))


def shifted(tokens: DataFrame, k: int, sample: str = "sample_id", pos: str = "pos", hidden: str = "hidden", mask: str = "mask") -> DataFrame:
    """Pair the prediction at a position with the target and mask k + 1 positions later; the last ones go."""
    w = Window.partitionBy(sample).orderBy(pos)
    return tokens.withColumns({"target": F.lead(hidden, k + 1).over(w), "target_mask": F.lead(mask, k + 1).over(w)}).where("target is not null")


def pad(v: Column, n: Column | int, fill: Column) -> Column:
    return F.concat(v, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(v), F.lit(0)) if isinstance(n, int) else F.greatest(n - F.size(v), F.lit(0))))


def fit_length(ids: Column, hidden: Column, longest: int, fill: int = 0) -> Column:
    """Identifiers cut or padded to the hidden states' length, at most ``longest``."""
    n = F.least(F.size(hidden), F.lit(longest))
    return F.slice(pad(ids, n, F.lit(fill)), F.lit(1), n)


def layer_indices(n: Column, mode: str) -> Column:
    """Layers that a fusion mode reads of a model with n layers."""
    whole = lambda *e: F.array(*[F.floor(x).cast("int") for x in e])
    if mode == "early,middle,final":
        return whole(n / 4, n / 2, 3 * n / 4)
    if mode == "first,middle,last":
        return whole(n - n, n / 2, n - 1)
    if mode == "all":
        return F.sequence(F.lit(0), n - 1)
    return F.array(*[F.lit(int(x)) for x in mode.split(",")])


def causal_mask(n: Column) -> Column:
    """Rows of a lower-triangular mask of n positions."""
    positions = F.sequence(F.lit(0), n - 1)
    return F.transform(positions, lambda r: F.transform(positions, lambda c: c <= r))


def position_ids(length: Column, k: Column) -> Column:
    return F.sequence(F.lit(0), length + k - 1)


def tree_inputs(ids: Column, draft: Column) -> Column:
    """Identifiers with their drafts, mask and positions."""
    n = F.size(ids) + F.size(draft)
    return F.struct(F.concat(ids, draft).alias("input_ids"), causal_mask(n).alias("mask"), F.sequence(F.lit(0), n - 1).alias("position_ids"))


def project(rows: DataFrame, hidden: str, weights: np.ndarray, out: str = "logits") -> DataFrame:
    """hidden x weights' rows, in Arrow batches: logits for large vocabularies."""
    w = weights.astype(np.float32).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = np.stack(b[hidden].to_numpy()).astype(np.float32) @ w if len(b) else np.zeros((0, w.shape[1]), np.float32)
            yield b.assign(**{out: list(made)})

    return rows.mapInPandas(run, rows.select("*", F.lit(None).cast("array<float>").alias(out)).schema)


def token_loss(tokens: DataFrame, by: list[str], student: str = "student", teacher: str = "teacher", mask: str = "mask") -> DataFrame:
    """Masked KL by vocabulary entry and accuracy of the argmax in per cent, over rows of logits."""
    m = F.col(mask).cast("double")
    v = F.size(F.col(student)).cast("double")
    p, lp, lq = softmax(F.col(teacher)), log_softmax(F.col(teacher)), log_softmax(F.col(student))
    kl = add(F.zip_with(p, F.zip_with(lp, lq, lambda a, b: a - b), lambda a, b: a * b))
    hit = (argmax(F.col(student)) == argmax(F.col(teacher))).cast("double")
    return tokens.groupBy(*by).agg((F.sum(kl * m) / (F.sum(m * v) + 1e-8)).alias("kl"), (100 * F.sum(hit * m) / (F.sum(m) + 1e-8)).alias("accuracy"))
