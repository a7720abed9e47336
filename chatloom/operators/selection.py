"""The first n rows of an order, found by histograms instead of a sort.

A row's place is a hexadecimal hash or a number. Counts by bucket of places tell the bucket
in which the n-th row lies; only that one is looked into more finely, until it has few
rows, whose places go to the driver. What is wanted is then a filter against a literal: one
scan, no shuffle of rows, and the same whatever is lost and made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that are read one by one, and hexadecimal digits that a histogram looks at.
FEW, DIGITS = 256, 3


@dataclass(frozen=True)
class Cut:
    """What is taken of a group: all places below ``place``, and of the rows there the keys up to ``key``; of the last
    key's rows only ``last`` (None: all of them). A place of None takes all rows."""

    place: str | None
    key: object = None
    last: int | None = None


def cuts(rows: DataFrame, group: str, place: Column, key: str, take: dict[str, int], few: int = FEW) -> dict[str, Cut]:
    """For each group (few, named by the caller), the cut that takes its first ``take`` rows by place, a hex string, then key.

    A job a refinement for all groups together; the driver gets 16 ** DIGITS counts a
    group at most, and places of ``few`` rows. Null keys come first, as in Spark's order.
    """
    mine = rows.where(F.col(group).isin(list(take))).select(F.col(group).alias("g"), place.alias("p"), F.col(key).alias("k"))
    out = {g: Cut("") for g, n in take.items() if n <= 0}
    open_ = {g: ("", n) for g, n in take.items() if n > 0}
    width = 0
    while open_:
        inside = F.lit(False)
        for g, (prefix, _) in open_.items():
            inside = inside | ((F.col("g") == g) & F.startswith("p", F.lit(prefix)))
        width += DIGITS
        counts: dict[str, list[tuple[str, int]]] = {}
        for g, p, n in mine.where(inside).groupBy("g", F.substr("p", F.lit(1), F.lit(width)).alias("p")).agg(F.count(F.lit(1))).collect():
            counts.setdefault(g, []).append((p, n))
        still: dict[str, tuple[str, int]] = {}
        ready: dict[str, tuple[str, int]] = {}
        for g, (prefix, left) in open_.items():
            for p, n in sorted(counts.get(g, [])):
                if n >= left:
                    whole = len(p) < width or width >= 32  # as fine as places get
                    (ready if n <= few or whole else still)[g] = (p, left)
                    break
                left -= n
            else:
                out[g] = Cut(None)
        for g, (p, left) in ready.items():
            out[g] = last_of(mine.where((F.col("g") == g) & F.startswith("p", F.lit(p))), left)
        open_ = still
    return out


def last_of(bucket: DataFrame, left: int) -> Cut:
    """The cut within a bucket. Rows of one key are counted, so that only distinct ones go to the driver."""
    found = bucket.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).orderBy("p", "k").limit(left).collect()
    for p, k, n in found:
        if n >= left:
            return Cut(p, k, None if n == left else left)
        left -= n
    return Cut(None)


def before(cut: Cut, place: Column, key: str) -> Column:
    """Rows that the cut takes, those of its last key included, however many they are."""
    if cut.place is None:
        return F.lit(True)
    k = F.col(key)
    up_to = k.isNull() if cut.key is None else k.isNull() | (k <= F.lit(cut.key))
    return (place < cut.place) | ((place == cut.place) & up_to)


def take_first(rows: DataFrame, group: str, place: Column, key: str, take: dict[str, int], few: int = FEW) -> DataFrame:
    """Each group's first ``take`` rows by place and key; all, if it has fewer. Rows of groups not named go.

    One filtered scan. Only where a group's last key has more rows than are wanted, these
    are taken by a limit, any of them.
    """
    found = cuts(rows, group, place, key, take, few)
    keep, ties = F.lit(False), []
    for g, cut in found.items():
        mine = F.col(group) == g
        if cut.last is not None:
            same = F.col(key).isNull() if cut.key is None else F.col(key) == F.lit(cut.key)
            tied = mine & (place == cut.place) & same
            ties.append(rows.where(tied).limit(cut.last))
            mine = mine & ~F.coalesce(tied, F.lit(False))
        keep = keep | (mine & before(cut, place, key))
    out = rows.where(keep)
    for t in ties:
        out = out.unionByName(t)
    return out


@dataclass(frozen=True)
class Filled:
    """Rows taken, and what it took to find them: the last place looked at, and how many times rows were read."""

    rows: DataFrame
    up_to: int | None
    reads: int


def fill_to(rows: DataFrame, keep: Column, target: int, order: str, buckets: int = 1024, few: int = FEW) -> Filled:
    """The first ``target`` rows by ``order``, a whole number, that pass ``keep``.

    ``keep`` is tried on the first stretch of the order, then, with the share that passed
    so far, on as much more as ought to do, until enough pass: what comes after is never
    tried. Stretches are filters on ``order``, which reach the scan. Counts by bucket of
    the order itself, which need no other column, say how long a stretch must be. Of rows
    alike in ``order`` at the end, any are taken; rows with a null order, or for which
    ``keep`` is null, don't pass.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None or target <= 0:
        return Filled(rows.where(F.lit(False)), None, 0)
    reads = 0

    def counted(part: DataFrame, start: int, width: int) -> list[tuple[int, int]]:
        return sorted((r[0], r[1]) for r in part.groupBy(F.floor((F.col(order) - start) / width).cast("long")).count().collect() if r[0] is not None)

    def between(a: int, b: int) -> Column:
        return (F.col(order) >= a) & (F.col(order) < b)

    start, end, left = low, high + 1, target
    while True:
        width = max(-(-(end - start) // buckets), 1)
        sizes = counted(rows.where(between(start, end)), start, width)
        at, tried, passed, hit = 0, 0, 0, None
        while at < len(sizes) and hit is None:
            rate = (passed + 1) / (tried + 1) if tried else 1.0
            want, upto, n = (left - passed) / rate * 1.2, at, 0
            while upto < len(sizes) and (n < want or upto == at):
                n += sizes[upto][1]
                upto += 1
            a, b = start + sizes[at][0] * width, start + (sizes[upto - 1][0] + 1) * width
            good = dict(counted(rows.where(between(a, min(b, end)) & keep), start, width))
            reads += 1
            for i in range(at, upto):
                if passed + good.get(sizes[i][0], 0) >= left:
                    hit = sizes[i]
                    break
                passed += good.get(sizes[i][0], 0)
            tried += n
            at = upto
        if hit is None:
            return Filled(rows.where(keep), None, reads)
        left -= passed
        start, end = start + hit[0] * width, min(start + (hit[0] + 1) * width, end)
        if hit[1] <= few or width == 1:
            break
    if width == 1:
        cut, same = start, left
    else:
        last = [r[0] for r in rows.where(between(start, end) & keep).select(order).orderBy(order).limit(left).collect()]
        cut = last[-1]
        same = last.count(cut)
    below = rows.where((F.col(order) < cut) & keep)
    return Filled(below.unionByName(rows.where((F.col(order) == cut) & keep).limit(same)), cut, reads)
