"""Arrow-batched maps over documents, with bounded memory however long texts are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are held as Python objects at once.
STEP = 512


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ...) from ``make()(texts)``, one tuple per text, in columns named by ``schema``.

    make is called once per task, so it can load what it needs there. Texts come as
    UTF-8 bytes, null as None. Nothing is shuffled, and any task can run again.
    """
    kind = df.schema[key].dataType.simpleString()
    whole = f"{key} {kind}, {schema}"
    to = df.sparkSession.createDataFrame([], whole).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                rows = apply(part.column(1).to_pylist())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.types[0]), *columns], schema=arrow)

    return df.select(key, F.col(text).cast("binary")).mapInArrow(run, to)
