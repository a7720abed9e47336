"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

If two words differ by one inserted, deleted or replaced code point, and the shorter has
``a`` of them, they share its first ``a // 2`` or its last ``a - a // 2``. So every word
stands in a forward dictionary under prefixes and in a reversed one under suffixes, for
``a`` its own length and one less; both are sorted over ranges, and each task scans its
range block by block. Within a block the edit lies in what the key leaves open: a block of
too many words, or one that a range's end may have cut, is subdivided the same way, by half
of what is left open at its front or at its end, until only one place is left open. Such
blocks are as large as the alphabet allows and are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import materialize

#: Words in a block that is compared in place; larger ones are subdivided.
BLOCK = 200
#: Code points that are compared at once, which bounds a task's memory.
CELLS = 1 << 22
#: How much more frequent the form of a word is.
RATIO = 10

FOUND = "word string, n long, near long, best_n long, best string, a int, i int, j int"
ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()), ("a", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])


def runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of Latin letters of ``least`` code points or more, A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(r"([a-zÀ-ÿ]{%d,})" % least), F.lit(1))


def misspelt(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, with a code point deleted where ``every`` divides the checksum of id and run; a null id is an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def dictionary(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """words: word -> word, n of the words that are long and frequent enough, written to the shared folder."""
    long = words.where(F.length("word") >= least_length)
    return materialize(long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count), "dictionary")


def comparison(codes: np.ndarray, length: np.ndarray, a: int, x: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart. A pair that a block further to the front holds too isn't counted here."""
    u, v = codes[x], codes[y]
    same = length[x] == length[y]
    out = np.zeros(len(x), bool)
    out[same] = (u[same] != v[same]).sum(1) == 1
    if not same.all():
        turn = length[x] > length[y]
        u[turn], v[turn] = v[turn], u[turn]
        u, v = u[~same], v[~same]
        front = np.cumprod(u[:, :a] == v[:, :a], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        back = np.cumprod((u[:, :a] == v[:, 1 : a + 1])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        fits = j[~same]
        out[~same] = (front + back >= a) & ((fits == 0) | (front < a - fits))
    return out


def near_pairs(words: list[str], a: int, j: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y of pairs one edit apart within blocks; rows are in order of blocks, and of words within them."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes = np.zeros((len(words), a + 1), np.uint32)
    codes[np.arange(a + 1) < length[:, None]] = points
    step = max(CELLS // (a + 1), 1)
    for d in range(1, int(np.bincount(block - block[0]).max())):
        x = np.flatnonzero(block[:-d] == block[d:])
        x = x[(length[x] == a) | (length[x + d] == a)]
        for at in range(0, len(x), step):
            part = x[at : at + step]
            hit = part[comparison(codes, length, a, part, part + d, j[part])]
            if len(hit):
                yield hit, hit + d


def links(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each word of the blocks that begin at ``starts``: how many are near it there, and which of them is most frequent."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    length = pc.utf8_length(rows.column("word")).to_numpy(zero_copy_only=False)
    all_a = rows.column("a").to_numpy()
    shortest = np.minimum.reduceat(length, starts) == all_a[starts]
    used = (sizes > 1) & shortest
    keep = np.flatnonzero(np.repeat(used, sizes))
    if not len(keep):
        return
    block = np.repeat(np.arange(len(sizes)), sizes)[keep]
    rows = rows.take(pa.array(keep))
    a, j, n = (rows.column(c).to_numpy() for c in ("a", "j", "n"))
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    begin = 0
    while begin < len(edges) - 1:  # whole blocks of one width, as many as fit the bound
        wide, end = int(a[edges[begin]]), begin + 1
        while end < len(edges) - 1 and a[edges[end]] == wide and (edges[end + 1] - edges[begin]) * (wide + 1) <= CELLS:
            end += 1
        lo, hi = edges[begin], edges[end]
        begin = end
        words = rows.column("word").slice(lo, hi - lo)
        found = list(near_pairs(words.to_pylist(), wide, j[lo:hi], block[lo:hi]))
        if not found:
            continue
        x, y = (np.concatenate(side) for side in zip(*found, strict=True))
        source, other = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((other, -n[lo:hi][other], source))
        source, other = source[order], other[order]
        first = np.flatnonzero(np.diff(source, prepend=-1))
        near = np.diff(np.append(first, len(source)))
        best = other[first]
        nothing = pa.nulls(len(first), pa.int32())
        columns = [words.take(pa.array(source[first])), pa.nulls(len(first), pa.int64()), pa.array(near), pa.array(n[lo:hi][best]), words.take(pa.array(best)), nothing, nothing, nothing]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def scan(most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows a, i, j, key, word, n in this order: links of the blocks, and the rows of blocks to subdivide.

    Those are blocks of more than ``most`` words and, since rows are dealt by ranges that
    may cut a block, the first and the last of a task. With None there are no such blocks.
    No more than a batch and a block of ``most`` words are held.
    """
    def opened(rows: pa.RecordBatch) -> pa.RecordBatch:
        gone = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.string())]
        return pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), *gone, *(rows.column(c) for c in ("a", "i", "j"))], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = None, most is not None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            changes = np.zeros(rows.num_rows, bool)
            changes[0] = True
            for c in ("a", "i", "j", "key"):
                values = rows.column(c)
                changes[1:] |= pc.not_equal(values.slice(1), values.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(changes)
            last, size = int(starts[-1]), rows.num_rows - int(starts[-1])
            done, starts = rows.slice(0, last), starts[:-1]
            only = not len(starts)
            if len(starts):
                large = np.zeros(len(starts), bool)
                if most is not None:
                    large = np.diff(np.append(starts, last)) > most
                    large[0] |= cut
                mark = np.repeat(large, np.diff(np.append(starts, last)))
                if mark.any():
                    yield opened(done.filter(pa.array(mark)))
                    done = done.filter(pa.array(~mark))
                    sizes = np.diff(np.append(starts, last))[~large]
                    starts = np.cumsum(sizes) - sizes
                if done.num_rows:
                    yield from links(done, starts)
            held = rows.slice(last)
            cut = cut and only
            if most is not None and (size > most or cut):
                if size > 1:
                    yield opened(held.slice(0, size - 1))
                held, cut = held.slice(size - 1), True
        if held is not None:
            if most is None:
                yield from links(held, np.zeros(1, np.int64))
            else:
                yield opened(held)

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """a, i, j, key, word, n: the key is the word's first i and, reversed, last j code points."""
    key = F.concat(F.substr("word", F.lit(1), F.col("i")), F.lit("\0"), F.substr(F.reverse("word"), F.lit(1), F.col("j")))
    return rows.select("a", "i", "j", key.alias("key"), "word", "n")


def scanned(rows: DataFrame, most: int | None) -> DataFrame:
    order = ["a", "i", "j", "key", "word"]
    dealt = keyed(rows).repartitionByRange(*(order[:-1] if most is None else order)).sortWithinPartitions(*order)
    return dealt.mapInArrow(scan(most), FOUND)


def neighbours(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """words: word, n -> word, near, best_n, best: partial counts of near words, and the most frequent of each part.

    Every pass is written to the shared folder; the driver sees two numbers of each. There
    are as many passes as halvings of the longest word, and all but the first take only
    what was left open.
    """
    side = lambda a, i, j: F.struct(a.cast("int").alias("a"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    length, none = F.length("word"), F.lit(0)
    forward = [side(a, F.floor(a / 2), none) for a in (length, length - 1)]
    reverse = [side(a, none, a - F.floor(a / 2)) for a in (length, length - 1)]
    rows = words.select("word", "n", F.explode(F.array(*forward, *reverse)).alias("s")).select("word", "n", "s.*").where("a > 0")
    out = []
    coarse, fine = scanned(rows, most), None
    while coarse is not None or fine is not None:
        parts = [p for p in (coarse, fine) if p is not None]
        found = materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "variants")
        out.append(found.where("a IS NULL").select("word", "near", "best_n", "best"))
        left = found.where("a IS NOT NULL").select("word", "n", "a", "i", "j")
        gap = F.col("a") - F.col("i") - F.col("j")
        wide, narrow = left.agg(F.count_if(gap > 1), F.count_if(gap <= 1)).first()
        half = F.floor(gap / 2)
        halves = F.explode(F.array(side(F.col("a"), F.col("i") + half, F.col("j")), side(F.col("a"), F.col("i"), F.col("j") + gap - half)))
        coarse = scanned(left.where(gap > 1).select("word", "n", halves.alias("s")).select("word", "n", "s.*"), most) if wide else None
        fine = scanned(left.where(gap <= 1), None) if narrow else None
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the last form that forms lead to. Pointers double their reach in every pass."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        made = materialize(joined, "roots")
        at = made.select("word", "root")
        if made.where("_moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """words: word, n -> word, form, root, n, n_near, form_n, each word once.

    Near words differ by exactly one code point inserted, deleted or replaced. The form of
    a word is its most frequent near word, ties to the smaller word, if that is at least
    ``ratio`` (over 1) times as frequent; else null. The root is where forms lead to, or
    the word itself. Null words are left out; repeated ones are one word with the sum of
    their n; an empty table gives none; other columns are ignored. Words longer than some
    millions of code points that share half of them are compared in memory, a block at a time.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    found = neighbours(words, most).select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")).alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<n:bigint,word:string>").alias("best"))
    summed = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.n") >= ratio * F.col("n")
    judged = materialize(summed.select("word", "n", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "forms")
    lead = roots(judged.where("form IS NOT NULL"))
    out = judged.join(lead, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
