"""SimHash near-duplicates verified by the Jaccard similarity of texts' sets of five-word shingles, every pair of 0.8 or more.

Five-word SimHashes within the index's radius (simhash.py) give the first candidates, which
the sets themselves verify: copies and most near copies are in one component after that.
A similarity of 0.8 leaves two fingerprints some ten bits apart, often with no byte in
common, so an index of positional bytes can't promise these pairs at any size of postings.
They have an exact way of their own, a prefix filter: with shingles in any one order, two
sets of similarity T share one of the first |S| - ceil(T |S|) + 1 shingles of each, so
only these are posted. The order is by hash, with shingles that a sample of the texts
repeats last; the sample decides how long postings are, never what is found. Where two sets
meet first, their shingles from there on must suffice for the similarity; a pair that
meets nowhere so is left out, which is most pairs that only share a passage. Parity
bitmaps leave out most pairs that meet (they differ in no more bits than the sets do in
shingles): a short one of a fixed size inside the join of postings, so that such pairs
are never made, then one as long as the set. The sets themselves decide the rest.

Texts with equal sets are linked first, and one of them is posted. Sets that SimHash has
put in one component are never paired again. In a posting of more than HOT sets each is
compared with a hub too: the one whose postings hold the most sets in all, which is the text that
the others are copies of, or near it. Only sets of different components are paired after that,
so a group of near copies isn't expanded into pairs.
Postings hold numbers only; sizes and short bitmaps come to them just before they are paired.

Cases: null, empty and blank texts have one set in common. Texts of fewer words than a
shingle are one shingle. Shingles are compared by their 64-bit hashes. Rows are told
apart by a number of their own, so ids may repeat or be null. Columns of the input are kept,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.arrow import map_texts
from chatloom.llm.common import CATALOGUED, delete, free, fresh_path, made, materialize, pack, release, unpack
from chatloom.llm.components import components
from chatloom.llm.sieve import BLOCK_BITS, bit, seen_before
from chatloom.llm.simhash import SEED, least_of_class, link_classes, majority, shingle_hashes
from chatloom.operators.skew import salted_join

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers: 0.8.
NUMER, DENOM = 4, 5
#: Sets in a posting above which it is contracted before its pairs are taken.
HOT = 64
#: Columns of the short bitmap that postings carry, 64 bits each.
SKETCH = ("q0", "q1", "q2", "q3")
#: Sets of crowded postings that a set is compared with before pairs are taken, those it meets most often.
TRIES = 3
#: Rows of a bucket, about, and most buckets; a block has as many rows as a bitmap of Spark's has bits.
BUCKET_ROWS, MAX_BUCKETS = 1 << 18, 4096
#: One document in so many is read for the order; a shingle is put last from so many of them, and so many shingles at most.
SAMPLED, OFTEN, LAST = 16, 4, 50_000


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, ascending; a text without words has the one shingle that is empty."""
    hashes = shingle_hashes(text, shingle)
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the number of shingles in each of as many classes as the set has shingles, about."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little").tobytes()


def sketch(s: np.ndarray) -> list[int]:
    """The same parity over a fixed number of classes, as the longs of SKETCH."""
    size = 64 * len(SKETCH)
    return np.packbits(np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little").view("<i8").tolist()


def prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set similar enough has one among its own; those in ``last`` (ascending) come last."""
    often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
    return np.r_[s[~often], s[often]][: len(s) + (-NUMER * len(s) // DENOM) + 1].view("<i8")


def may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps may be similar enough."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = 8 * len(a), 8 * len(b)
    while p > q:
        p //= 2
        x = (x >> p) ^ (x & (1 << p) - 1)
    while q > p:
        q //= 2
        y = (y >> q) ^ (y & (1 << q) - 1)
    return (x ^ y).bit_count() * (DENOM + NUMER) <= (n + m) * (DENOM - NUMER)


#: Shingles of texts as they are sent to be compared: compressed, which is less than their hashes take.
packed_set = functools.lru_cache(32)(lambda packed: shingle_set(zlib.decompress(packed)))


def similar(a: bytes, b: bytes) -> bool:
    x, y = packed_set(a), packed_set(b)
    if NUMER * max(len(x), len(y)) > DENOM * min(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return DENOM * shared >= NUMER * (len(both) - shared)


def chosen(pairs: DataFrame, test, columns: list[str]) -> DataFrame:
    """a, b of the rows for which test(*columns) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                on = pa.array([test(*r) for r in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(on), part.column(1).filter(on)], ["a", "b"])

    return pairs.select("a", "b", *columns).mapInArrow(run, "a long, b long")


def sweep(spark: SparkSession, *done: DataFrame) -> None:
    """Remove the tables, and the shuffle files of writes that have ended."""
    for df in done:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(spark, path)
    free(spark)


def linked(pairs: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Distinct pairs a, b -> those of enough similarity."""
    rows = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(map_texts(chosen_rows(texts, buckets, rows, True), lambda: lambda ts: [(zlib.compress(t or b"", 1),) for t in ts], "s binary", "id"), "packed")
    sweep(texts.sparkSession)
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("s")), sets.select(F.col("id").alias("b"), F.col("s").alias("t"))
    out = materialize(chosen(pairs.join(left, "a").join(right, "b"), similar, ["s", "t"]), "links")
    sweep(texts.sparkSession, sets, pairs)
    return out


def near_copies(texts: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """texts: id and block as numbered() gives them, text -> id, label: the smallest id of its component; only linked ones occur."""
    sample = map_texts(texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0), lambda: lambda ts: [(shingle_set(t).view("<i8"),) for t in ts], "s array<long>", "id")
    often = sample.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    last = np.sort(np.array([r.s for r in often.orderBy(F.desc("n"), "s").limit(LAST).collect()], np.int64).view(np.uint64))
    del sample, often
    free(texts.sparkSession)

    def make():
        def sign(t: bytes | None) -> tuple:
            s = np.unique(h) if len(h := shingle_hashes(t, SHINGLE)) else shingle_set(None)
            return majority(h), len(s), xxhash.xxh128_digest(s.tobytes()), bitmap(s), *sketch(s), prefix(s, last)

        return lambda ts: [sign(t) for t in ts]

    longs = ", ".join(f"{q} long" for q in SKETCH)
    made = map_texts(texts, make, f"fp long, n int, key binary, bits binary, {longs}, prefix array<long>", "id")
    signed = bucketed(made.withColumn("block", F.shiftright("id", BLOCK_BITS)), buckets, "signed")
    firsts = materialize(signed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    sets = chosen_rows(signed, buckets, firsts.select(F.col("first").alias("id")), True)
    # SimHash: each set and the least set of its component of fingerprints
    prints = materialize(sets.groupBy("fp").agg(F.min("id").alias("rep")), "prints")
    centre = materialize(least_of_class(prints, link_classes(prints.select("fp"), early=True)), "centres")
    sweep(texts.sparkSession)
    near = salted_join(sets.select("id", "fp"), centre, "fp", F.col("id"), "inner").select(F.col("id").alias("x"), F.col("least").alias("y"))
    # postings are many times the sets: what is known of a set joins them where they are paired, and isn't moved with them before
    posted = sets.select("id", F.posexplode("prefix").alias("i", "k"))
    counts = materialize(posted.groupBy("k").agg(F.count(F.lit(1)).alias("posted")).where("posted > 1"), "counts")
    sweep(texts.sparkSession)
    shared = materialize(seen_before(posted, ["k"], counts).join(counts, "k"), "postings")
    sweep(texts.sparkSession, counts)

    def met(pairs: DataFrame) -> DataFrame:
        """pairs: x, y (numbers of sets) -> distinct a < b that may be similar enough. Sizes and bitmaps come to distinct pairs only."""
        flat = materialize(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "met")
        # few sets meet any: only their bitmaps are moved
        some = chosen_rows(signed, buckets, flat.select(F.explode(F.array("a", "b")).alias("id")).distinct(), True)
        left, right = some.select(F.col("id").alias("a"), F.col("bits").alias("p"), "n"), some.select(F.col("id").alias("b"), F.col("bits").alias("q"), F.col("n").alias("m"))
        sized = NUMER * F.greatest("n", "m") <= DENOM * F.least("n", "m")
        out = materialize(chosen(flat.join(left, "a").join(right, "b").where(sized), may_link, ["p", "q", "n", "m"]), "pairs")
        sweep(texts.sparkSession, flat)
        return out

    crowded = shared.where(F.col("posted") > hot).select("k", "id")
    # a set in the middle of a group has the fewest shingles of its own, so its postings hold the most sets
    ids = materialize(crowded.select("id").distinct(), "crowded")
    held = seen_before(shared.select("id", "posted"), ["id"], ids).groupBy("id").agg(F.sum("posted").alias("held"))
    hub = F.max(F.struct("held", F.xxhash64("id").alias("h"), F.col("id").alias("y"))).alias("c")
    centres = materialize(crowded.join(held, "id").groupBy("k").agg(hub).select("k", "c.y"), "hubs")
    around = salted_join(crowded, centres, "k", F.col("id"), "inner").where("id <> y").groupBy(F.col("id").alias("x"), "y").agg(F.count(F.lit(1)).alias("met"))
    around = around.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("met", "y")), False), 1, TRIES).alias("ys"))
    around = around.select("x", F.explode("ys.y").alias("y"))
    first = materialize(components(linked(met(near.unionByName(around)), texts, buckets)), "contracted")
    labels = first.select(F.col("node").alias("id"), "label")
    about = signed.select("id", "n", *SKETCH).join(labels, "id", "left").select("id", "n", *SKETCH, F.coalesce("label", "id").alias("comp"))
    known = lambda crowd: shared.where(crowd).select("k", "id", "i").join(about, "id")
    # crowded postings within one component are settled; of the rest, all but the largest component's members seek partners
    members = known(F.col("posted") > hot)
    sizes = members.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("k").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("top"), F.count(F.lit(1)).alias("comps"))
    members = materialize(members.join(largest.where("comps > 1"), "k"), "members")
    del sizes, largest
    sweep(texts.sparkSession)

    def partners(rows: DataFrame, one_way: Column) -> DataFrame:
        """rows of postings -> x, y of different components that meet early enough and whose short bitmaps allow for the similarity."""
        a, b = rows.alias("a"), rows.alias("b")
        # a similarity of T takes T / (1 + T) of both sizes in common: so much must be left from the first shared shingle on
        enough = (NUMER + DENOM) * F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= NUMER * (F.col("a.n") + F.col("b.n"))
        differ = functools.reduce(Column.__add__, [F.bit_count(F.col(f"a.{q}").bitwiseXOR(F.col(f"b.{q}"))) for q in SKETCH])
        alike = (NUMER + DENOM) * differ <= (DENOM - NUMER) * (F.col("a.n") + F.col("b.n"))
        on = (F.col("a.k") == F.col("b.k")) & (F.col("a.comp") != F.col("b.comp")) & one_way & enough & alike
        return a.join(b, on).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))

    # short postings, most of all, take no count of components: both sides of their join are then the same rows, which are shuffled once
    ascending = F.col("a.id") < F.col("b.id")
    few = partners(known(F.col("posted") <= hot), ascending)
    many = partners(members, (F.col("a.comp") != F.col("a.top")) & (ascending | (F.col("b.comp") == F.col("a.top"))))
    links = linked(met(few.unionByName(many)), texts, buckets)
    sweep(texts.sparkSession, shared, members)
    edges = links.unionByName(first.select(F.col("node").alias("a"), F.col("label").alias("b")))
    copies = signed.join(firsts.where("copies > 1"), "key").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return components(edges.unionByName(copies)).select(F.col("node").alias("id"), "label")


def bucketed(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """rows (with block, 2^BLOCK_BITS of their numbers) in a table whose buckets hold whole blocks: what is known by
    block joins it without moving a row."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")  # a task has one bucket or a few: no sort for them
    try:
        CATALOGUED[path := fresh_path(spark, name)] = table
        rows.write.option("compression", "zstd").bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", held)
    return spark.table(table)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """_row, id (unique) and block, bucketed, and the number of buckets."""
    rows = pack(docs).withColumn("id", F.monotonically_increasing_id()).withColumn("block", F.shiftright("id", BLOCK_BITS))
    buckets = min(MAX_BUCKETS, max(8, docs.count() // BUCKET_ROWS))
    return bucketed(rows, buckets, "numbered"), buckets


def chosen_rows(rows: DataFrame, buckets: int, ids: DataFrame, there: bool) -> DataFrame:
    """rows: numbered(), or columns of it with id and block; ids: id -> the rows whose id is ``there``, or the others.

    The ids meet the rows as one bitmap a block, into which only the ids are shuffled.
    """
    low = F.lit((1 << BLOCK_BITS) - 1)
    bits = ids.select(F.shiftright("id", BLOCK_BITS).alias("block"), F.col("id").bitwiseAND(low).alias("at"))
    bits = bits.repartition(buckets, "block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("_bits"))
    on = bit(F.col("_bits"), F.col("id").bitwiseAND(low).cast("int"))
    joined = rows.join(bits.hint("shuffle_hash"), "block", "inner" if there else "left")
    return joined.where(on if there else F.col("_bits").isNull() | ~on).select(*rows.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each component, the one with the smallest key; a null key comes last."""
    rows, buckets = numbered(docs)
    since = len(made())
    found = materialize(near_copies(rows.select("id", "block", F.col("_row").getField(text).alias("text")), buckets, hot), "near-copies")
    who = F.col("_row").getField(key)
    named = found.join(rows.select("id", F.struct(who.isNull().alias("none"), who.alias("key"), F.col("id").alias("row")).alias("who")), "id")
    best = named.groupBy("label").agg(F.min("who").alias("least"))
    gone = salted_join(named, best, "label", F.col("id"), "inner").where(F.col("id") != F.col("least.row")).select("id")
    gone = materialize(gone, "dropped")
    release(docs.sparkSession, since, keep=[made()[-1]])
    return unpack(chosen_rows(rows, buckets, gone, False))
