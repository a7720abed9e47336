"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, a byte at each of 8 positions. Two fingerprints that differ
in D bits or fewer agree in at least P - D of any P positional bytes. The index posts each
distinct fingerprint under its bytes at every set of S of P positions, so such a pair meets
in at least as many postings as there are sets of S among P - D. Pairs that meet are tallied;
those below this guaranteed minimum are left out; the rest are verified bit by bit. P and S
follow the number of fingerprints, so that postings stay short; each setting finds every link.

Copies never meet: only distinct fingerprints are posted. In a posting of more than
HOT fingerprints, links of up to two bits are found first, through shared one-bit
neighbours (a linear number of rows), and only fingerprints of different components
are paired after that. So a group of near copies isn't expanded into pairs, and no
link between different texts is lost.

Cases: null, empty and blank texts have fingerprint zero and link like any other. Texts
of fewer words than a shingle are one shingle. Repeated rows are kept. A component's
id is its smallest non-null document id. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.arrow import map_texts
from chatloom.llm.common import free, materialize
from chatloom.llm.components import components
from chatloom.llm.sieve import seen_before
from chatloom.operators.skew import salted_join

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints in a posting above which it is contracted before its pairs are taken.
HOT = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; of a text without words, none."""
    words = (text or b"").translate(LOWER).split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)] if words else [])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fp (long)."""
    return map_texts(docs, lambda: lambda texts: [(fingerprint(t, shingle),) for t in texts], "fp long", key)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(n: int, bits: int = MAX_BITS) -> tuple[list[int], int]:
    """Masks of the position sets to index ``n`` distinct fingerprints by, and the guaranteed minimum of shared postings.

    Longer sets make rarer keys. The shortest are taken for which random fingerprints have
    fewer than about four partners each; beyond that, sets as long as a pair must share.
    """
    for p, s in [*((p, p - bits - 1) for p in range(bits + 3, 9)), (8, 8 - bits)]:
        sets = list(combinations(range(p), s))
        if s == 8 - bits or len(sets) * n / 2 ** (8 * s) < 4:
            return [signed(sum(0xFF << 8 * i for i in of)) for of in sets], comb(p - bits, s)
    raise ValueError(bits)


def contract(hot: DataFrame) -> DataFrame:
    """hot: fp -> node, label. Components by links of two bits or fewer: such fingerprints, and no others, share a
    neighbour of one bit or are one another's."""
    flips = F.transform(F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64)]), lambda f: F.col("fp").bitwiseXOR(f))
    near = hot.select("fp", F.explode(flips).alias("at"))
    star = near.withColumn("m", F.min("fp").over(Window.partitionBy("at"))).where("m <> fp")
    return components(star.select(F.col("fp").alias("a"), F.col("m").alias("b")))


def link_classes(distinct: DataFrame, bits: int = MAX_BITS, hot: int = HOT, early: bool = False) -> DataFrame:
    """distinct: fp (one row each) -> fp, label: the smallest fingerprint of its component; only linked ones occur.

    ``early``: pairs are verified where they meet, before they are tallied, so that only links become rows. The links are the same.
    """
    sets, least = masks(distinct.count(), bits)
    keys = F.array(*map(F.lit, sets))
    posted = distinct.select("fp", F.posexplode(F.transform(keys, lambda m: F.col("fp").bitwiseAND(m))).alias("c", "k"))
    # counted by a partial aggregate and joined, which splits long postings; a window would bring each to one task
    counts = materialize(posted.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    free(distinct.sparkSession)
    # most postings have one fingerprint: they are left out before the others are shuffled to their counts
    shared = materialize(seen_before(posted, ["c", "k"], counts).join(counts, ["c", "k"]), "postings")
    free(distinct.sparkSession)
    crowded = shared.where(F.col("n") > hot).select("fp").distinct()
    contracted = bits >= 2 and not crowded.isEmpty()
    if contracted:
        first = materialize(contract(crowded), "contracted")
        members = shared.join(first, shared.fp == first.node, "left").select("c", "k", "fp", F.coalesce("label", "fp").alias("comp"))
        # postings within one component are settled; of the rest, all but the largest component's members seek partners
        sizes = members.groupBy("c", "k", "comp").agg(F.count(F.lit(1)).alias("m"))
        largest = sizes.groupBy("c", "k").agg(F.max_by("comp", F.struct("m", -F.col("comp").cast("decimal(20,0)"))).alias("top"), F.count(F.lit(1)).alias("comps"))
        members = materialize(members.join(largest.where("comps > 1"), ["c", "k"]), "members")
    else:
        members = shared.select("c", "k", "fp", F.col("fp").alias("comp"), F.lit(None).cast("long").alias("top"))
    a, b = members.alias("a"), members.alias("b")
    one_way = (F.col("a.comp") != F.col("b.comp")) & (F.col("a.top").isNull() | (F.col("a.comp") != F.col("a.top"))) & ((F.col("a.fp") < F.col("b.fp")) | (F.col("b.comp") == F.col("a.top")))
    met = (F.col("a.c") == F.col("b.c")) & (F.col("a.k") == F.col("b.k"))
    near = lambda x, y: F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= bits
    # the count filter: in how many postings does a pair meet? A posting has each pair once
    pairs = a.join(b, met & one_way & near("a", "b") if early else met & one_way).select(*[F.struct(F.col(f"{x}.fp").alias("fp"), F.col(f"{x}.comp").alias("comp")).alias(x) for x in "ab"])
    tally = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count(F.lit(1)).alias("shared"))
    tally = materialize(tally.where(F.col("shared") >= least), "tallied")
    free(distinct.sparkSession)
    edges = tally.where(near("x", "y")).select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b"))
    if contracted:
        edges = edges.unionByName(first.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    return components(edges).select(F.col("node").alias("fp"), "label")


def least_of_class(distinct: DataFrame, labels: DataFrame) -> DataFrame:
    """distinct: fp, rep; labels: fp, label -> fp, least: the smallest rep of the fingerprints of its component."""
    whole = distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "rep")
    least = whole.groupBy("label").agg(F.min("rep").alias("least"))
    return salted_join(whole, least, "label", F.col("fp"), "inner").select("fp", "least")


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (the smallest key it reaches)."""
    prints = materialize(fingerprints(docs, key, shingle), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    labels = link_classes(distinct.select("fp"), bits)
    of = least_of_class(distinct, labels).withColumnRenamed("least", "component_id")
    found = salted_join(prints, of, "fp", F.col(key), "inner")
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
