"""Spelling variants, ring sharding and the filter audit against brute force, and odd rows."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from chatloom.llm import filter_audit, queries, sharding, spelling

from test_llm import DOCS, ODD, SF, docs, empty, odd  # noqa: F401

# 11


def edits(u, v):
    """Exactly one code point inserted, deleted or replaced."""
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("most", [1, 3, 200])
def test_variants(spark, most):
    """Words of two letters, so that they are crowded, at every size of block; long ones, and other scripts."""
    rnd = random.Random(most)
    counts = {"".join(rnd.choices("ab", k=rnd.randint(1, 9))): rnd.choice([1, 2, 30, 400, 5000]) for _ in range(400)}
    counts |= {"x" * 3000: 5, "x" * 2999 + "y": 60, "x" * 2999: 700, "日本語": 1, "日本": 20, "\U0001f600a": 3, "\U0001f600": 40, "é": 2}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.group_variants(rows, most=most)
    assert {tuple(r) for r in got.collect()} == brute_variants(counts)


def test_variants_of_odd_words(spark):
    rows = [("abcd", 3, "x"), ("abcd", 30, "y"), (None, 5, "z"), ("abce", 2, None), ("", 4, "e")]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long, form string"))
    assert sorted(tuple(r) for r in got.collect()) == [("", None, "", 4, 0, None), ("abcd", None, "abcd", 33, 1, None), ("abce", "abcd", "abcd", 2, 1, 33)]
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="more frequent"):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_misspelt(spark, odd):  # noqa: F811
    """Runs and deletions of odd rows, and the whole dictionary of the table, as plain Python makes them."""
    import re

    def damaged(rows):
        for r in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
                yield w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w

    def made(df):
        runs = df.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
        return runs.select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))

    assert Counter(r.word for r in made(odd).collect()) == Counter(damaged(ODD))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {w: n for w, n in Counter(damaged(table.select("doc_id", "text").collect())).items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.dictionary(made(table)).collect()} == want


# 12


def test_ring_against_a_simulation(spark, docs, monkeypatch):  # noqa: F811
    """Documents one by one, in the order of their turns: each goes clockwise to the first shard that isn't full."""
    monkeypatch.setattr(sharding, "CLOSE", 0.0)
    measured = sharding.measure(spark.createDataFrame(docs), 5)
    plan = sharding.fill(measured, 5)
    got = {r.row: r.shard for r in sharding.place(measured, plan).collect()}
    rows = sorted(measured.collect(), key=lambda r: r.turn)
    _, shard_of = sharding.nodes(5)
    total, load, full, want = sum(r.size for r in rows), [0] * 5, set(), {}
    for i, r in enumerate(rows):
        at = r.stretch
        while shard_of[at % len(shard_of)] in full:
            at += 1
        s = want[r.row] = shard_of[at % len(shard_of)]
        load[s] += r.size
        if i + 1 < len(rows) and rows[i + 1].turn == r.turn:
            continue  # a turn comes as a whole
        capacity = lambda: (1 + sharding.SPARE) * (total - sum(load[f] for f in full)) / (5 - len(full))
        while len(full) < 4 and (over := {x for x in range(5) if x not in full and load[x] >= capacity()}):
            full |= over
    assert got == want


def test_balance_and_movement(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97 * 10 + 1).cast("int")).alias("text"))
    measured = sharding.measure(rows, 24)
    placed = sharding.place(measured, sharding.fill(measured, 24))
    sizes = [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.005 * sum(sizes) / 24 and min(sizes) > 0.99 * sum(sizes) / 24
    again = sharding.measure(rows, 25)
    grown = sharding.place(again, sharding.fill(again, 25)).select("row", F.col("shard").alias("to"))
    both = placed.join(grown, "row")
    moved = both.where("shard <> to").count()
    assert both.where("to = 24").count() > 1000 and moved < 0.2 * 30_000


def test_one_id_of_a_third_of_the_rows_overflows(spark):
    """Rows of one id, and null ids, have one place on the ring, and still fill no shard beyond its share."""
    rows = spark.range(6000).select(F.when(F.col("id") < 2000, 7).when(F.col("id") < 3000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    out = sharding.shard_documents(rows, 6)
    per = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert len(per) == 6 and all(r.n == r.last + 1 == r.slots for r in per)
    assert all(abs(r.n - 1000) < 30 for r in per)


def test_sharding_of_odd_rows(spark, odd, empty):  # noqa: F811
    out = sharding.shard_documents(odd.withColumns({"shard": F.lit("x"), "slot": F.lit(1)}), 4)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out.collect()) == want
    assert sorted(r.slot for r in out.where("shard = 0").collect()) == list(range(out.where("shard = 0").count()))
    assert sharding.shard_documents(empty).count() == 0
    again = sharding.shard_documents(odd, 4)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_sharding_query(spark):
    out = queries.QUERIES["op12_sharding"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d.doc_id, len(d.text.encode()) + 8, zlib.crc32(d.text.encode())) for d in table)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    fair = sum(load.values()) / 24
    assert all(load[s] < 1.01 * fair + max(r.size for r in out if r.shard == s) for s in load)


# 13


def brute_audit(docs_, labels):  # noqa: C901
    import re

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, t, *_ in docs_:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = Counter()
    parts = defaultdict(list)
    for i, t, _, source, *_ in docs_:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in smallest and smallest[t] < i}
        parts[source or ""].append((i, "".join(f for f in "ABCDE" if fails[f])))
    for part, rows in parts.items():
        taken = Counter()
        for order in permutations("ABCDE"):
            for i, f in rows:
                gone = next((s for s, x in enumerate(order) if x in f), 5)
                for s, x in enumerate(order):
                    key = (part, "".join(order), s + 1)
                    out[*key, "kept"] += gone > s
                    out[*key, "removed"] += gone == s
                    out[*key, "redundant"] += x in f and gone < s
                    out[*key, "unique_fails"] += f == x
                    out[*key, "good_lost"] += gone == s and i in good
                    out[*key, "toxic_lost"] += gone == s and i in toxic
                    taken[x] += gone == s
        for order in permutations("ABCDE"):
            for s, x in enumerate(order):
                out[part, "".join(order), s + 1, "shapley"] = taken[x]
    return out


LABELS = [(1, 1, 0), (2, None, 1), (2, 0, 0), (6, 1, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (5, 0, None)]


@pytest.mark.parametrize("parts", [1, 256])
def test_audit_of_odd_rows(spark, odd, empty, parts, monkeypatch):  # noqa: F811
    monkeypatch.setattr(filter_audit, "PARTS", parts)
    labels = spark.createDataFrame(LABELS, "doc_id int, quality int, toxic int").withColumn("part", F.lit("clash"))
    more = [(10, "same text here " * 10, "en", "c", 1), (5, "same text here " * 10, "en", None, 1), (11, "", "en", "a", 1), (None, "", None, "", 0), (12, "A" * 9 + " $", "en", "z", 3)]
    rows = odd.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True).withColumns({"mask": F.lit(3), "key": F.lit("k"), "good": F.lit(1)})
    got = filter_audit.audit(rows, labels).collect()
    want = brute_audit([*ODD, *more], LABELS)
    assert {(r.part, r.filter_order, r.step, c): r[c] for r in got for c in filter_audit.COUNTS} == dict(want)
    assert filter_audit.audit(empty, labels).count() == 0


def test_audit_of_a_third_of_all_rows_alike(spark):
    """A hot source, a text that a third of the rows share, and an id that a third of them have."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, "copy").otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    labels = [(5, 1, 0), (7, 1, 1), (10, 0, 1)]
    got = filter_audit.audit(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit([tuple(r) for r in rows.collect()], labels)
    assert {(r.part, r.filter_order, r.step, c): r[c] for r in got for c in filter_audit.COUNTS} == dict(want)
