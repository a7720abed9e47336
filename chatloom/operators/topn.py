"""The first rows of each group, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(group: str, order: list[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of all rows of a task, the first n of each group by ``order``, rising, nulls first; n rows a group and a batch are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in [group, *order]], null_placement="at_start"))
            codes = pc.rank(rows.column(group), sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy()
            number = pc.subtract(pa.array(range(1, rows.num_rows + 1), pa.int64()), pa.array(codes.astype("int64")))
            held = rows.filter(pc.less(number, n)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return run


def first_rows(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group by ``order``, which should be unique within it. Null is a group like any other.

    Each task keeps n rows a group, and only those are shuffled, so a group may hold any
    share of all rows.
    """
    best = keep_first(group, order, n)
    return rows.mapInArrow(best, rows.schema).repartition(F.col(group)).mapInArrow(best, rows.schema)
