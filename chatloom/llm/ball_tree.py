"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

The upper nodes of one tree, laid out by a sample, deal the vectors to shards, so that a
shard is a tight ball; a shard of too many rows (copies can't be split by place) is cut
into parts by a hash. A query asks its best shard first, by the upper bound q.c + |q| r, then
the next few, then the rest; the kth score over all that it has seen is shared with all
shards of the next wave, and a shard whose bound is below it isn't asked. What a part is
asked for is cut into blocks of queries, and each part and block is a task's unit of work. A
task builds its part's tree and lets the queries stream past it: each goes down to the leaf
of the best bound, whose scores give a first kth score, then visits its other leaves in the
order of their bounds, leaving out every node below the current kth score.

The sample (SAMPLE vectors) and the shards (MOST_SHARDS) are bounded, and decide which
vectors are together and never what is found.

Cases: vectors that are null or hold null or non-finite components take no part; nor
do null ids. Shorter vectors are padded with zeros. Scores are integers, exact in double
precision, in 64-bit integers or in integers of any size, by what a shard's components
need; an OverflowError says if a score of the result doesn't fit in 64 bits. Ties go to the
smaller id. Rows that repeat an id are candidates one by one, but never of a query with
their id; of the rows with a query's id, one asks. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.common import materialize

K = 20
SCALE = 64
#: Rows of a shard or part, about; components of one at most; queries that meet it at once, and those of a unit of work.
SHARD_ROWS, SHARD_CELLS, BLOCK_ROWS, UNIT_ROWS = 8192, 1 << 23, 8192, 32768
#: Vectors that the upper tree is laid out by, its shards at most, and shards that a query asks in the first waves.
SAMPLE, MOST_SHARDS, WAVES = 20_000, 4096, (1, 3, 12)
#: Where bounds leave out less than this share of what is left to ask, all of it is asked at once.
WORTH = 0.5
#: Slots by which a shard's rows are cut into parts.
SLOTS = 1 << 16
LEAF = 64
RESULT = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes over the rows of ``v``: centre, radius, and the span of ``order`` that a node holds."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(v))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        self._v = v.astype(np.float64)
        todo = [(0, len(v), None)]
        while todo:
            lo, hi, parent = todo.pop()
            rows = self._v[self.order[lo:hi]]
            c = rows.mean(axis=0)
            far = np.sqrt(((rows - c) ** 2).sum(axis=1))
            at = len(self.centre)
            self.centre.append(c)
            self.radius.append(far.max())
            self.span.append((lo, hi))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(at)
            if hi - lo > leaf and far.max() > 0:
                a = rows[far.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows @ (b - a), half)]
                todo += [(lo, lo + half, at), (lo + half, hi, at)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def bound(self, q: np.ndarray, norm: np.ndarray, n: int) -> np.ndarray:
        """Upper bounds of the queries' products with the rows of node n, above rounding."""
        size = np.sqrt((self.centre[n] ** 2).sum()) + self.radius[n]
        return q @ self.centre[n] + norm * (self.radius[n] + 1e-9 * size) + 1e-6

    def first_leaf(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The leaf where each query ends that always takes the child of the larger bound."""
        at = np.zeros(len(q), np.int64)
        todo = [0] if self.children[0] else []
        while todo:
            n = todo.pop()
            here = np.flatnonzero(at == n)
            if len(here):
                left, right = self.children[n]
                at[here] = np.where(self.bound(q[here], norm[here], left) >= self.bound(q[here], norm[here], right), left, right)
                todo += [c for c in (left, right) if self.children[c]]
        return at

    def leaves(self, q: np.ndarray, norm: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a query and a leaf whose upper bound, and those of the nodes above it, reach the query's ``least``: query, leaf, bound."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        todo = [(0, np.arange(len(q)))]
        while todo:
            n, who = todo.pop()
            bound = self.bound(q[who], norm[who], n)
            on = bound >= least[who]
            who, bound = who[on], bound[on]
            if not len(who):
                continue
            if self.children[n]:
                todo += [(c, who) for c in self.children[n]]
            else:
                out.append((who, np.full(len(who), n), bound))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best(q: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query, in order, and their ranks from 0."""
    by = np.lexsort((ident, -score, q))
    q, score, ident = q[by], score[by], ident[by]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
    top = rank < k
    return q[top], score[top], ident[top], rank[top]


class Shard:
    """The vectors of a shard, with their tree; ``search`` can be called for many blocks of queries."""

    def __init__(self, v: np.ndarray, ids: np.ndarray) -> None:
        self.v, self.ids = v, ids
        self.tree = BallTree(v)
        self.largest = max((abs(int(x)) for x in (v.max(initial=0), v.min(initial=0))), default=0)

    def kind(self, q: np.ndarray) -> type:
        """Numbers in which all products of this shard are exact."""
        worst = self.largest * max(abs(int(x)) for x in (q.max(initial=0), q.min(initial=0))) * self.v.shape[1]
        return np.float64 if worst < 2**53 else np.int64 if worst < 2**63 else object

    def search(self, q: np.ndarray, qids: np.ndarray, least: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer queries -> query number, id and score of each one's k best here, less those below ``least``, the kth scores known so far."""
        kind, tree, ids = self.kind(q), self.tree, self.ids
        v, exact = self.v.astype(kind), q.astype(kind)
        q = q.astype(np.float64)
        norm = np.sqrt((q**2).sum(axis=1))
        least = np.nextafter(least.astype(np.float64), -np.inf)  # a double may be above the score that it stands for
        none = np.zeros(0, np.int64)
        have = none, np.zeros(0, object if kind is object else np.int64), none

        def visit(who: np.ndarray, leaf: np.ndarray) -> None:
            """Score the leaves' rows for their queries, and raise the kth scores."""
            nonlocal have
            found = [have]
            by = np.argsort(leaf, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(by) else []:
                a, b = tree.span[leaf[part[0]]]
                rows, asks = tree.order[a:b], who[part]
                for at in range(0, len(rows), 4096):  # a leaf of equal vectors can be long
                    some = rows[at : at + 4096]
                    s = exact[asks] @ v[some].T
                    x, y = np.nonzero((s >= least[asks][:, None]).astype(bool) & (ids[some][None, :] != qids[asks][:, None]))
                    found.append((asks[x], s[x, y] if kind is object else s[x, y].astype(np.int64), ids[some][y]))
            fq, fs, fi, rank = best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            have = fq, fs, fi
            full = rank == k - 1
            least[fq[full]] = np.maximum(least[fq[full]], np.nextafter(fs[full].astype(np.float64), -np.inf))

        first = tree.first_leaf(q, norm)
        hopeful = np.flatnonzero(tree.bound(q, norm, 0) >= least)
        visit(hopeful, first[hopeful])
        who, leaf, bound = tree.leaves(q, norm, least)
        fresh = leaf != first[who]
        who, leaf, bound = who[fresh], leaf[fresh], bound[fresh]
        by = np.lexsort((-bound, who))
        who, leaf, bound = who[by], leaf[by], bound[by]
        start = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        turn = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0)) if len(who) else none
        lo, width = 0, 1
        while lo <= turn.max(initial=-1):
            now = (turn >= lo) & (turn < lo + width) & (bound >= least[who])
            visit(who[now], leaf[now])
            lo, width = lo + width, width * 2
        score = have[1]
        if kind is object:
            if any(abs(x) >= 2**63 for x in score):
                raise OverflowError("a score doesn't fit in 64 bits")
            score = score.astype(np.int64)
        return have[0], have[2], score


def matrix(column: pa.ChunkedArray, d: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column as int64, padded with zeros to d components."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    lengths = np.diff(a.offsets.to_numpy())
    flat = np.floor(scale * a.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) >= 2**62:
        flat = np.array([int(x) for x in flat], object)
    out = np.zeros((len(a), d), flat.dtype if flat.dtype == object else np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return out


class Layout:
    """The upper nodes of a tree: for each the way to its children, and for each leaf, a shard, its centre."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        v = sample.astype(np.float64)
        self.turn, self.limit, self.children, leaves = [], [], [], []
        todo = [(len(v), 0, np.arange(len(v)), None)]  # the largest first
        while todo:
            todo.sort(key=lambda t: (t[0], -t[1]))
            _, number, rows, parent = todo.pop()
            split = self.halves(v[rows]) if len(todo) + len(leaves) + 1 < shards and len(rows) > 1 else None
            at = -len(leaves) - 1 if split is None else len(self.turn)
            if parent is not None:
                self.children[parent[0]][parent[1]] = at
            if split is None:
                leaves.append(v[rows].mean(axis=0) if len(rows) else np.zeros(v.shape[1]))
                continue
            turn, limit, left = split
            self.turn.append(turn)
            self.limit.append(limit)
            self.children.append([0, 0])
            todo += [(left.sum(), 2 * number + 1, rows[left], (at, 0)), ((~left).sum(), 2 * number + 2, rows[~left], (at, 1))]
        self.centre = np.array(leaves)

    @staticmethod
    def halves(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        """A direction, a limit and the rows up to it; None for rows that can't be told apart."""
        c = rows.mean(axis=0)
        a = rows[((rows - c) ** 2).sum(axis=1).argmax()]
        b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
        along = rows @ (b - a)
        for limit in (np.median(along), along.mean(), along.min()):
            left = along <= limit
            if 0 < left.sum() < len(rows):
                return b - a, float(limit), left
        return None

    def route(self, v: np.ndarray) -> np.ndarray:
        """The shard of each row."""
        at = np.zeros(len(v), np.int64) if self.turn else np.full(len(v), -1)
        todo = [0] if self.turn else []
        while todo:
            n = todo.pop()
            here = np.flatnonzero(at == n)
            if len(here):
                left, right = self.children[n]
                at[here] = np.where(v[here] @ self.turn[n] <= self.limit[n], left, right)
                todo += [c for c in (left, right) if c > 0]
        return -at - 1

    def reach(self, v: np.ndarray, shard: np.ndarray) -> np.ndarray:
        return np.sqrt(((v - self.centre[shard]) ** 2).sum(axis=1))

    def bounds(self, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Upper bounds of the queries' products with each shard's rows, above rounding; shards without rows have none."""
        norm, size = np.sqrt((q**2).sum(axis=1)), np.sqrt((self.centre**2).sum(axis=1)) + np.maximum(radius, 0)
        out = q @ self.centre.T + norm[:, None] * (np.maximum(radius, 0) + 1e-9 * size) + 1e-6
        out[np.isnan(out)] = np.inf
        out[:, radius < 0] = -np.inf
        return out


def units(counts: dict[int, int], asked: dict[int, int], part_rows: int, unit_rows: int) -> tuple[dict[int, tuple[int, int, int]], int]:
    """For each shard that is asked: its first unit of work, its parts (of up to twice ``part_rows``) and its blocks of
    queries; and the number of units."""
    out, base = {}, 0
    for shard, n in sorted(asked.items()):
        parts, blocks = -(-counts[shard] // (2 * part_rows)), -(-n // unit_rows)
        out[shard] = (base, parts, blocks)
        base += parts * blocks
    return out, base


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, shard_rows: int | None = None, block_rows: int = BLOCK_ROWS, unit_rows: int = UNIT_ROWS, asked_log: list[int] | None = None) -> DataFrame:
    """vectors: vec_id, embedding -> query_id, rank, vec_id, score: each query's k best other rows by the inner product
    of floor(scale * x). shard_rows: by default, what gives every core some shards, within the bounds above. asked_log gets
    the number of pairs of a query and a shard that each wave asks."""
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    n, longest = v.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    d = max(1, longest or 1)
    if shard_rows is None:
        shard_rows = min(max(SHARD_ROWS // 8, min(SHARD_ROWS, n // (2 * cores))), max(SHARD_ROWS // 8, SHARD_CELLS // d))
    shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
    order = F.xxhash64("vec_id", "embedding")
    some = v.select("vec_id", "embedding").where(F.pmod(order, F.lit(1 << 20)) <= max(1, 2 * SAMPLE * (1 << 20) // max(n, 1))).orderBy(order).limit(SAMPLE)
    drawn = some.select("embedding").toArrow()
    layout = Layout(matrix(drawn["embedding"], d, scale).astype(np.float64) if drawn.num_rows else np.zeros((0, d)), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(pa.chunked_array([batch.column(1)]), d, scale).astype(np.float64)
            shard = layout.route(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(layout.reach(rows, shard))], [*batch.schema.names, "shard", "reach"])

    # dealt once and written; slots by row and not by id, so that rows which repeat an id spread too
    slot = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(SLOTS)).cast("int")
    dealt = materialize(v.select("vec_id", "embedding", "asks", slot.alias("slot")).mapInArrow(deal, "vec_id long, embedding array<double>, asks boolean, slot int, shard int, reach double"), "shards")
    q = materialize(dealt.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    counts, radius = {}, np.full(len(layout.centre), -1.0)
    for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect():  # MOST_SHARDS rows at most
        counts[r.shard], radius[r.shard] = r.n, np.inf if r.reach != r.reach else r.reach

    def ask(lo: int, hi: int, count: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query with the shards of its lo-th to hi-th bound that reach its kth score so far; only their numbers, if counted."""
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    rows = matrix(pa.chunked_array([part.column(1)]), d, scale).astype(np.float64)
                    bound = layout.bounds(rows, radius)
                    least = np.nextafter(part.column(2).to_numpy(), -np.inf)
                    best = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
                    held = np.take_along_axis(bound, best, 1)
                    who, place = np.nonzero((held >= least[:, None]) & (held > -np.inf))
                    shard = pa.array(best[who, place].astype(np.int32))
                    if count:
                        yield pa.RecordBatch.from_arrays([shard, pa.array(place.astype(np.int32))], ["shard", "place"])
                    else:
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(who)).columns, shard], ["vec_id", "embedding", "least", "shard"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by unit: a part's vectors, then its queries."""
        held: list[pa.RecordBatch] = []
        shard, now = None, None
        for batch in batches:
            number, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(number) | np.diff(asks)) + 1
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if number[at] != now:
                    held, shard, now = [], None, number[at]
                part = batch.slice(at, to - at)
                if not asks[at]:
                    held.append(part)
                    continue
                if shard is None and held:
                    rows = pa.Table.from_batches(held)
                    shard, held = Shard(matrix(rows["embedding"], d, scale), rows["vec_id"].to_numpy()), []
                for i in range(0, part.num_rows if shard else 0, block_rows):
                    block = pa.Table.from_batches([part.slice(i, block_rows)])
                    qids = block["vec_id"].to_numpy()
                    who, ids, score = shard.search(matrix(block["embedding"], d, scale), qids, block["least"].to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = materialize(spark.createDataFrame([], RESULT), "nearest")
    lo, total_queries = 0, q.count()
    for width in (*WAVES, len(layout.centre)):
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        known = q.join(kth.select(F.col("query_id").alias("vec_id"), F.col("kth").cast("double")), "vec_id", "left").select("vec_id", "embedding", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
        known = known.repartition(2 * cores, "vec_id")
        left = known.mapInArrow(ask(lo, len(layout.centre), True), "shard int, place int").groupBy("shard")
        sums = left.agg(F.count_if(F.col("place") < width).alias("now"), F.count(F.lit(1)).alias("all")).collect()  # a row a shard
        if lo and sum(r["all"] for r in sums) > (1 - WORTH) * total_queries * (len(layout.centre) - lo):
            width = len(layout.centre)  # noqa: PLW2901
        many = {r.shard: n for r in sums if (n := r["all"] if width == len(layout.centre) else r["now"])}
        asked = known.mapInArrow(ask(lo, lo + width, False), "vec_id long, embedding array<double>, least double, shard int")
        if asked_log is not None:
            asked_log.append(sum(many.values()))
        if not many:
            break
        plan, total = units(counts, many, shard_rows, unit_rows)
        base, parts, blocks = ([plan.get(s, (0, 0, 0))[i] for s in range(len(layout.centre))] for i in range(3))
        of = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ","), F.col("shard")).cast("int")
        numbers = spark.range(len(layout.centre)).select(F.col("id").cast("int").alias("shard")).select("shard", of(base).alias("base"), of(parts).alias("parts"), of(blocks).alias("blocks")).where("parts > 0")
        mine = F.floor(F.col("slot") * F.col("parts") / SLOTS).cast("int")
        unit = lambda part, block: (F.col("base") + part * F.col("blocks") + block).cast("int").alias("unit")
        here = dealt.select("shard", "slot", "vec_id", "embedding").join(F.broadcast(numbers), "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        here = here.select(unit(mine, F.col("block")), F.lit(0).alias("asks"), "vec_id", "embedding", F.lit(None).cast("double").alias("least"))
        there = asked.join(F.broadcast(numbers), "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        there = there.select(unit(F.col("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks"))), F.lit(1).alias("asks"), "vec_id", "embedding", "least")
        tasks = min(total, max(8 * cores, 200))
        rows = here.unionByName(there).repartitionById(tasks, F.col("unit") % tasks).sortWithinPartitions("unit", "asks").mapInArrow(run, RESULT)
        found = materialize(found.unionByName(rows).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "nearest")
        lo += width
        if lo >= len(layout.centre):
            break
    return found.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
