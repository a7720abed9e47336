"""Filter interaction audit: what each filter removes, in every order of the filters.

With five filters a document is one of 32 sets of failed filters, and an order of the
filters removes it at the first of them that it fails. So a table of 32 by 120 says at
which step any document goes in any order, and counts per part and set say everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import materialize, words_of
from chatloom.operators.skew import salted_join

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Filter at each step of each order, 120 by 5.
LETTER = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])
_fails = np.arange(32)[:, None, None] >> LETTER[None] & 1
#: Step, from 0, at which a set of failed filters is removed in an order; 5 if it is kept. 32 by 120.
REMOVED_AT = np.where(_fails.any(2), _fails.argmax(2), len(FILTERS))
#: Parts whose counts a task holds at once.
PARTS = 256
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D, which look at a text alone; null is the empty text."""
    t = F.coalesce(text, F.lit(""))
    words = words_of(t)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 2 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source -> part, mask (bit per failed filter, A lowest), good, toxic, n: rows alike in these and in id and text.

    E compares by a 128-bit hash and the length of the text with all rows of smaller id,
    removed or not; a null id is smaller than none, and none is smaller than it. Equal
    rows are counted before anything is joined, so neither many copies of a text nor many
    rows of an id meet in a task: the first id of a text joins by text and id.
    """
    text = F.coalesce("text", F.lit(""))
    mask = F.lit(0)
    for bit, failed in enumerate(failures(F.col("text")).values()):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    key = F.struct(F.md5(text.cast("binary")).alias("hash"), F.octet_length(text).alias("size")).alias("key")
    alone = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), key, mask.alias("mask"))
    rows = materialize(alone.groupBy("doc_id", "part", "key").agg(F.first("mask").alias("mask"), F.count(F.lit(1)).alias("n")), "verdicts")
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = known.join(first, ["doc_id", "key"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n", F.xxhash64("key", "part").alias("row"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    joined = salted_join(known, marks, "doc_id", F.col("row"))
    unknown = rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return joined.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n").unionByName(unknown)


def count_removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows part, mask, good, toxic, n -> part, order, step and COUNTS, for the parts and rows of this task."""
    size, steps = len(ORDERS), len(FILTERS)
    shape = (size, steps)
    order_no = np.arange(size)
    names = ["part", "filter_order", "step", *COUNTS]
    held: dict[str, np.ndarray] = {}

    def add(parts: list[str], part: np.ndarray, mask: np.ndarray, weights: dict[str, np.ndarray]) -> None:
        total = len(parts)
        cell = (part[:, None] * size + order_no) * (steps + 1) + REMOVED_AT[mask]
        tally = lambda w: np.bincount(cell.ravel(), np.repeat(w, size), total * size * (steps + 1)).astype(np.int64).reshape(total, size, steps + 1)
        out = {name: tally(w)[:, :, :steps] for name, w in weights.items()}
        whole = np.bincount(part, weights["removed"], total).astype(np.int64)
        fails, alone = (np.stack([np.bincount(part, weights["removed"] * test(f), total).astype(np.int64) for f in range(steps)], 1) for test in (lambda f: mask >> f & 1, lambda f: mask == 1 << f))
        removed = out["removed"]
        out["kept"] = whole[:, None, None] - removed.cumsum(2)
        out["redundant"] = fails[:, LETTER] - removed
        out["unique_fails"] = alone[:, LETTER]
        of = np.stack([np.where(LETTER == f, removed, 0).sum((1, 2)) for f in range(steps)], 1)
        out["shapley"] = of[:, LETTER]
        for i, name in enumerate(parts):
            counts = np.stack([out[c][i] for c in COUNTS])
            held[name] = held[name] + counts if name in held else counts

    def flush() -> Iterator[pa.RecordBatch]:
        for name, counts in held.items():
            flat = [pa.array(c.ravel()) for c in counts]
            where = [pa.array([name] * (size * steps)), pa.array(np.repeat(ORDERS, steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), size))]
            yield pa.RecordBatch.from_arrays([*where, *flat], names)
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            coded = rows.column(0).dictionary_encode()
            mask, good, toxic, n = (rows.column(i).to_numpy().astype(np.int64) for i in range(1, 5))
            parts = coded.dictionary.to_pylist()
            part = coded.indices.to_numpy().astype(np.int64)
            for low in range(0, len(parts), PARTS):
                mine = (part >= low) & (part < low + PARTS)
                add(parts[low : low + PARTS], part[mine] - low, mask[mine], {"removed": n[mine], "good_lost": (n * good)[mine], "toxic_lost": (n * toxic)[mine]})
                if len(held) > PARTS:
                    yield from flush()
    yield from flush()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic -> one row per part, order of the filters and step.

    part, filter_order, step, and in the part's documents: kept after the step, removed in
    it, redundant (failing its filter, but gone before), unique_fails (failing that filter
    only), good_lost and toxic_lost (removed here, by label), shapley (what the filter
    removes in all orders). All rows count, repeated ones as often as they occur; a null
    source is the empty one, a null label is none, of several labels of an id any that is 1
    counts. An empty table gives no rows. Other columns of either table are ignored.
    """
    groups = verdicts(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))
    few = groups.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).repartition("part")
    partial = few.mapInArrow(count_removals, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
