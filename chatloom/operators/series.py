"""Moving and running values of long series, of which there may be few.

A series is cut into blocks of consecutive rows, so that its length is shared by many
tasks. Moving windows get the rows they need from the blocks to either side (a halo);
running values come from a scan in two levels, within blocks and over the blocks' totals.
Null keys are a series like any other. The order must be unique within a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.sampling import global_rank

#: Rows of a block.
ROWS = 50_000

FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def laid_out(series: DataFrame, by: list[str], order: list[str], rows: int = ROWS) -> DataFrame:
    """series with _ord, its row's number in the order of all series, and _block. Written to the shared folder."""
    ranked = global_rank(series, [F.col(c) for c in [*by, *order]], "_ord")
    return ranked.withColumn("_block", F.floor((F.col("_ord") - 1) / rows).cast("long"))


def with_totals(rows: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """rows with aggregates of their series, which are as many rows as there are series."""
    totals = rows.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(*[a.alias(n) for n, a in aggregates.items()])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(totals, same).drop(*[f"_by{i}" for i in range(len(by))])


def moving(laid: DataFrame, by: list[str], before: int, after: int, rows: int = ROWS, **values: Column) -> DataFrame:
    """laid with aggregates over the rows from ``before`` before to ``after`` after each row of its series.

    A row is repeated into a neighbouring block only where a window of that block reaches it:
    before + after rows in ``rows``.
    """
    if max(before, after) > rows:
        raise ValueError("a block must be as long as a window reaches")
    at = (F.col("_ord") - 1) % rows
    to = [F.lit(0), F.when(at < after, F.lit(-1)), F.when(at >= rows - before, F.lit(1))]
    spread = laid.withColumn("_to", F.explode(F.filter(F.array(*to), lambda x: x.isNotNull())))
    spread = spread.withColumn("_block", F.col("_block") + F.col("_to"))
    w = Window.partitionBy(*by, "_block").orderBy("_ord").rowsBetween(-before, after)
    return spread.withColumns({n: v.over(w) for n, v in values.items()}).where("_to = 0").drop("_to")


def running(laid: DataFrame, by: list[str], exclusive: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """laid with running sums, minima or maxima (name=("sum", column)), of all rows of the series so far, the row's own
    included unless ``exclusive``. Nulls don't count; null where there is nothing yet."""
    parts = {f"_{n}": c for n, (_, c) in values.items()}
    rows = laid.withColumns(parts)
    totals = rows.groupBy(*by, "_block").agg(*[FOLDS[kind][0](f"_{n}").alias(f"_{n}") for n, (kind, _) in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_by{i}" for i in range(len(by))]
    starts = totals.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_block").alias("_from"), *[FOLDS[kind][0](f"_{n}").over(earlier).alias(f"_{n}0") for n, (kind, _) in values.items()])
    within = Window.partitionBy(*by, "_block").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    same = F.col("_block") == F.col("_from")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    own = rows.withColumns({f"_{n}1": FOLDS[kind][0](f"_{n}").over(within) for n, (kind, _) in values.items()}).join(starts, same)
    out = own.withColumns({n: FOLDS[kind][1](F.col(f"_{n}0"), F.col(f"_{n}1")) for n, (kind, _) in values.items()})
    return out.drop("_from", *names, *parts, *[f"_{n}{i}" for n in values for i in (0, 1)])
