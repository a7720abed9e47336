"""Texts that hold one of many passages, found by the rarest words of each passage.

A passage's first and last word may be parts of longer words in a text, but those between
stand there whole. Of these, up to three in a row that hold the rarest word are the
passage's anchor. One scan of the texts gives postings (anchor, row, word number) without
any text; the texts of rows that have some are fetched once, and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.bind import let
from chatloom.operators.tables import materialize

#: Words of an anchor at most; anchors and rows that are broadcast at most (some 16 bytes each).
ANCHOR, BROADCAST = 3, 2_000_000
#: One text in so many is counted to tell rare words: it decides which anchor a passage has, never a result.
COUNTED = 16


def words(c: Column) -> Column:
    """What stands between single blanks, empty words included, so that the words joined again are the text."""
    return F.split(c, " ")


def small(rows: DataFrame) -> DataFrame:
    """rows, broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def anchored(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """passages: passage, of three words or more -> passage, pw (its words), at (the anchor's first word, from 0), n, anchor."""
    inner = passages.select("passage", words(F.col("passage")).alias("pw"))
    each = inner.select("passage", F.posexplode(F.slice("pw", 2, F.size("pw") - 2)).alias("pos", "word"))
    wanted = materialize(each.select("word").distinct(), "wanted")
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    counts = some.join(small(wanted), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(counts, "word", "left").groupBy("passage").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("df", F.lit(0)).alias("df")))).alias("d"))
    n = F.least(F.size("d"), F.lit(ANCHOR))

    def best(d: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(1), F.size(d) - F.least(F.size(d), F.lit(ANCHOR)) + 1), lambda i: F.struct(F.array_min(F.transform(F.slice(d, i, ANCHOR), lambda x: x.df)).alias("df"), i.alias("at")))
        return F.array_min(starts).at

    at = rare.select("passage", let(F.col("d"), best).cast("int").alias("at"), n.cast("int").alias("n"))
    found = inner.join(at, "passage")
    return found.withColumn("anchor", F.xxhash64(F.slice("pw", F.col("at") + 1, F.col("n"))))


def runs(text: Column, n: int) -> Column:
    """Hashes of all n words in a row; null if there are fewer."""
    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n))))

    return let(words(text), hashes)


def holding_rows(docs: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """docs: ``key``, a value of its own for each row, and text; passages: passage, all different, of three words or more ->
    key of each row that holds one. Nothing but hits is shuffled: keys, word numbers, and the texts of rows that have some."""
    found = materialize(anchored(passages, docs), "anchors")
    sizes = [r.n for r in found.select("n").distinct().collect()]
    if not sizes:
        return docs.select(key).where(F.lit(False))
    hits = None
    for n in sorted(sizes):
        of = small(found.where(F.col("n") == n).select("anchor").distinct())
        mine = docs.select(F.col(key).alias("_k"), F.posexplode(runs(F.col("text"), n)).alias("word_no", "anchor"))
        mine = mine.join(of, "anchor", "left_semi").withColumn("n", F.lit(n))
        hits = mine if hits is None else hits.unionByName(mine)
    hits = materialize(hits, "postings")
    texts = docs.select(F.col(key).alias("_k"), "text").join(small(hits.select("_k").distinct()), "_k", "left_semi")
    pairs = hits.join(found.select("anchor", "n", "pw", "at"), ["anchor", "n"]).join(texts.select("_k", words(F.col("text")).alias("w")), "_k")
    first = F.col("word_no") - F.col("at") + 1
    m = F.size("pw")
    fits = (first >= 1) & (first + m - 1 <= F.size("w"))
    same = F.slice("w", F.greatest(first, F.lit(1)) + 1, m - 2) == F.slice("pw", F.lit(2), m - 2)
    ends = F.endswith(F.get("w", first - 1), F.get("pw", F.lit(0))) & F.startswith(F.get("w", first + m - 2), F.get("pw", m - 1))
    return pairs.where(fits & same & ends).select(F.col("_k").alias(key)).distinct()
