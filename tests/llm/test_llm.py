"""The training-data operators against brute force, exact round trips, and odd rows."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import ball_tree, chat_format, components, cotraining, licenses, line_dedup, mixing, near_copies, pieces, quality_rules, queries, simhash, token_counts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, " \n\t ", "en", "a", 4),
    (3, "one", "en", "b", 3),
    (4, LONG, "de", "b", len(LONG)),
    (5, "é ü 日本語 \U0001f600 x y", "fr", "c", 9),
    (6, "same text here " * 10, "en", "c", 150),
    (6, "same text here " * 10, "en", "c", 150),
    (7, "null\0byte\x85and lines\r\nCRLF \\ back <|im_end|>", "en", None, 30),
    (None, "no id at all, but words " * 3, "en", "a", 70),
    (-9, "x" * 5000, "en", "d", 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = "kept boolean, _n int, size long, h string, fp long, lines string"
    return spark.createDataFrame([(*r, True, 1, 2, "h", 3, "l") for r in ODD], f"{DOCS}, {extra}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="session")
def llm_duck():
    c = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, llm_duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = llm_duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda cols, rows: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(names, want.fetchall())


# 1


def brute_measures(t):
    t = t or ""
    w = words(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [s for s in t.split("\n") if s.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd):
    got = quality_rules.features(odd).select("doc_id", *[f"_q_{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    want = sorted(repr((r[0], *brute_measures(r[1]))) for r in ODD)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 0  # each is too short or repeats itself


def test_quality_hosts(spark):
    good = "a clean text of ten words and some more than that"
    bad = "# # # # symbols everywhere in this short text of words now"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good if i % 10 else bad, "good") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    kept = {r.doc_id for r in quality_rules.filter_documents(df).collect()}
    assert kept == {i for i in range(100) if i % 10 == 0} | set(range(100, 200))
    assert quality_rules.filter_documents(df.limit(0)).count() == 0


# 2


def test_cotraining(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = []
    for i in range(600):
        y = i % 2
        text = " ".join(rng.choice(good if y else bad, 30)) + " common words"
        rows.append((i, text, "en" if y or i % 10 == 0 else "xx", f"s{i % 3 if y else 5 + i % 3}", len(text), y))
    df = spark.createDataFrame(rows, f"{DOCS}, y int")
    labels = df.where("doc_id < 100").select("doc_id", F.col("y").alias("quality"))
    found = cotraining.classify(df, labels).join(df.select("doc_id", "y"), "doc_id").where("doc_id >= 100").collect()
    assert sum(r.kept == bool(r.y) for r in found) > 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def replayed(docs, labels, rounds=4):
    """Scores by dense features in one process, documents one by one. docs: (id, text, lang, source, length), ids unique."""

    def text_row(t):
        w, raw = words((t or "").translate({c: c + 32 for c in range(65, 91)})), (t or "").encode()
        x = np.zeros(2056)
        for b, n in Counter(zl(v) % 2048 for v in w).items():
            x[b] = math.log1p(n)
        x /= max(1e-6, math.sqrt((x * x).sum()))
        lines, size = raw.split(b"\n"), max(1, len(raw))
        share = lambda chars: 10 * min(1.0, (size - len(raw) + sum(c in chars for c in raw)) / size)
        x[2048:] = [math.log1p(len(w)) / 10, len(raw) / max(1, len(w)) / 10, len(set(w)) / max(1, len(w)), share(b"#*$%&|<>{}[]=_@"), share(b"0123456789"), share(bytes(range(65, 91))), len(set(lines)) / len(lines), len(w) < 10]
        return x.astype(np.float32)

    def meta_row(lang, source, n):
        x = np.zeros(cotraining.META, np.float32)
        x[list(cotraining.meta_buckets(source, lang, n))] = 1
        return x

    x = [np.array([text_row(d[1]) for d in docs]), np.array([meta_row(*d[2:]) for d in docs])]
    order = sorted((zl(str(d[0]).encode()), i) for i, d in enumerate(docs) if d[0] in labels)
    rows = [i for _, i in order]
    y = np.array([labels[docs[i][0]] for i in rows], float)
    train, held = [i for i in range(len(rows)) if i % 5 != 4], [i for i in range(len(rows)) if i % 5 == 4]
    pool = sorted(set(range(len(docs))) - set(rows))
    share = y[train].mean()
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    one = [np.c_[v.astype(float), np.ones(len(v))] for v in x]
    w, sure_of = [cotraining.fit(x[v][np.array(rows)[train]], y[train], np.ones(len(train))) for v in (0, 1)], [0, 0]
    for _ in range(rounds):
        p = [sig(one[v] @ w[v]) for v in (0, 1)]
        given = [{i: int(p[1 - v][i] >= 0.5) for i in pool if max(p[1 - v][i], 1 - p[1 - v][i]) >= 0.9} for v in (0, 1)]
        sure_of = [len(g) for g in given]
        for _ in range(cotraining.PASSES):
            new = []
            for v in (0, 1):
                tilt = cotraining.Tilt(w[v], np.zeros_like(w[v]), np.zeros_like(w[v]), 0.0)
                for label, part in ((0, 1 - share), (1, share)):
                    members = [i for i, c in given[v].items() if c == label]
                    if members:
                        total = min(0.5 * len(train) * part, 0.5 * len(members))
                        f, z = one[v][members], np.clip(one[v][members] @ w[v], -30, 30)
                        tilt.gradient += total / len(members) * (sig(z) - label) @ f
                        tilt.curve += total / len(members) * (np.tanh(z / 2) / (2 * z) * np.abs(f).sum(axis=1)) @ np.abs(f)
                        tilt.weight += total
                new.append(cotraining.fit(x[v][np.array(rows)[train]], y[train], np.ones(len(train)), tilt=tilt))
            w = new
    on = np.array(rows)[held]
    z = [x[v][on].astype(np.float32) @ w[v][:-1].astype(np.float32) + w[v][-1] for v in (0, 1)]
    cal = [cotraining.fit(a[:, None].astype(np.float32), y[held], np.ones(len(held)), l2=1e-4, steps=500) for a in z]
    mix = cotraining.fit(np.stack([c[0] * a + c[1] for c, a in zip(cal, z, strict=True)], axis=1).astype(np.float32), y[held], np.ones(len(held)), steps=500)
    both = [c[0] * (x[v] @ w[v][:-1] + w[v][-1]) + c[1] for v, c in enumerate(cal)]
    return {d[0]: s for d, s in zip(docs, sig(mix[0] * both[0] + mix[1] * both[1] + mix[2]), strict=True)}, sure_of


def zl(b):
    import zlib

    return zlib.crc32(b)


def test_cotraining_replay(spark, docs):
    """The whole small table against a replay of the rounds in one process."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    want, sure = replayed(rows, {r.doc_id: r.quality for r in labels.collect()})
    assert min(sure) > 0  # both views have labelled documents for the other
    got = {r.doc_id: r.score for r in cotraining.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_cotraining_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    assert cotraining.classify(odd, labels).count() == len(ODD)
    assert {r.score for r in cotraining.classify(odd, labels.where("false")).collect()} == {0.5}
    assert cotraining.classify(empty, labels).count() == 0


# 3


def brute_top(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for q, a in {i: v for i, v in sorted(ok, reverse=True)}.items():
        if q % 20 == 0:
            best = sorted((-dot(a, b), i) for i, b in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard", [8, 64, 10_000])
def test_top_k(spark, shard):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist() if i % 3 else [0.5] * 6) for i in range(200)]
    rows += [(1000, None), (1020, [float("nan")] * 6), (1040, [1.0, None]), (1060, [float("inf")]), (None, [1.0]), (1080, [1.0, 2.0]), (1100, []), (7, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 20 == 0, 20, shard_rows=shard, block_rows=5).collect()}
    assert got == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_large_numbers(spark):
    """Products beyond double precision and beyond 64 bits on the way, of finite outliers."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 9)).tolist()) for i in range(80)]
    rows += [(101, [1e30, 0.0, 0.0, 0.0]), (102, [-1e25, 0.0, 0.0, 0.0])]  # outliers that meet queries of zeros there
    rows = [(i, [0.0, *v[1:]] if i % 20 == 0 else v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in ball_tree.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=16).collect()} == brute_top(rows, 5)
    with pytest.raises(Exception, match="64 bits"):
        ball_tree.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], df.schema), F.col("vec_id") == 0).collect()


def test_shards_left_out(spark):
    """On clustered vectors most queries ask few shards; a third of the rows alike is cut into parts; blocks of few queries."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(30, 8))[rng.integers(0, 30, 2000)] * 4 + rng.normal(size=(2000, 8)) / 20
    v[::3] = v[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(6)
    asked = []
    got = ball_tree.top_k(df, F.col("vec_id") % 20 == 0, 20, shard_rows=40, unit_rows=7, asked_log=asked)
    assert {tuple(r) for r in got.collect()} == brute_top(list(enumerate(v.tolist())), 20)
    assert asked[0] == 100 and sum(asked) < 0.5 * 100 * 50
    layout = ball_tree.Layout(np.floor(64 * v), 50)
    shard = layout.route(np.floor(64 * v))
    assert len(layout.centre) > 20 and set(shard) <= set(range(len(layout.centre)))
    radius = np.array([layout.reach(np.floor(64 * v)[shard == s], np.full((shard == s).sum(), s)).max(initial=-1) for s in range(len(layout.centre))])
    bound = layout.bounds(np.floor(64 * v)[:9], radius)
    assert all(bound[i, shard[j]] >= np.floor(64 * v[i]) @ np.floor(64 * v[j]) for i in range(9) for j in range(2000))
    assert ball_tree.units({0: 100, 2: 5}, {0: 15, 2: 1}, 20, 7) == ({0: (0, 3, 3), 2: (9, 1, 1)}, 10)


def test_tree_prunes():
    """On clustered vectors most leaves fall; the answers stay those of brute force."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] * 60 + rng.normal(size=(6000, 16))).astype(np.int64)
    shard, seen = ball_tree.Shard(v, np.arange(6000)), []
    leaves = shard.tree.leaves
    shard.tree.leaves = lambda *a: seen.append(out := leaves(*a)) or out
    who, ids, score = shard.search(v[:50], np.full(50, -1), np.full(50, -np.inf), 20)
    s = v[:50] @ v.T
    for i in range(50):
        by = np.lexsort((np.arange(6000), -s[i]))[:20]
        assert ids[who == i].tolist() == by.tolist() and score[who == i].tolist() == s[i][by].tolist()
    assert len(seen[0][0]) < 0.5 * 50 * sum(not c for c in shard.tree.children)


# 4


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"menu  \n\nown {i}\nmenu\n", "h") for i in range(9)] + [(9, None, "h"), (10, "menu", "other"), (11, "menu", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[3].text == "\nown 3\n" and (got[3]._n_lines, got[3]._n_dropped) == (5, 2)
    assert got[9].text is None and got[10].text == "menu" and got[11].text == "menu"
    line_dedup.BROADCAST_LINES, held = 0, line_dedup.BROADCAST_LINES
    try:
        assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()} == {k: r.text for k, r in got.items()}
    finally:
        line_dedup.BROADCAST_LINES = held
    assert line_dedup.drop_boilerplate(odd).select(*odd.columns).count() == len(ODD)
    assert line_dedup.drop_boilerplate(empty).count() == 0


# 5


def test_pieces(spark, odd, empty, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rng = np.random.default_rng(7)
    alphabet = list("abcdefgh  ethniorsABC.,;:!?()\"'-\n0123▁éü$%{}[]_*/\\日😀\t")
    texts = [r[1] for r in ODD] + [r.text for r in docs] + ["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 150, 400)] + [",,,!!!...", "    x  y", "a▁b", LONG.replace(" ", "")]
    encode = pieces.vocabulary(queries.PIECES).encoder()
    for t, b in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == sp.encode(t or ""), t[:100]
    # runs of blanks of every length, before and after words, marks and characters without a piece
    runs = [f"{a}{' ' * n}{b}" for n in range(1, 70) for a, b in (("", ""), ("x", "y"), ("", "word"), ("a,", ", b"), ("x", "日"), ("x\n", "\n"), (")", "."))]
    # long cuts: no blank, in several blocks
    signs = list("abc日本語漢字學校\U0001f600é...\u2014\u0378")
    long = ["".join(rng.choice(signs, n)) for n in (257, 1000, 250_001)] + ["ab" * 130_000, "." * 5000]
    assert pieces.vocabulary(queries.PIECES).blank_runs
    held, pieces.REMEMBERED = pieces.REMEMBERED, 20_000
    try:
        small = pieces.vocabulary(queries.PIECES).encoder()  # forgets all the time
        for texts in (runs, long, ["  ".join(runs)], texts[:40]):
            for t, b, c in zip(texts, encode(texts), small(texts), strict=True):
                assert np.frombuffer(b, "<u2").tolist() == sp.encode(t or ""), t[:100]
                assert b == c
    finally:
        pieces.REMEMBERED = held
    both = pieces.encode_and_decode(odd, queries.PIECES)
    assert both.columns == [*odd.columns, "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in both.collect())
    apart = pieces.decode(pieces.encode(odd, queries.PIECES), queries.PIECES)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, both.collect()))
    assert pieces.encode(empty, queries.PIECES).count() == 0


# 6


def brute_print(t, n=3):
    low = (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not low:
        return 0
    sh = [b" ".join(low[i : i + n]) for i in range(len(low) - n + 1)] or [b" ".join(low)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """id -> smallest id within reach of 3 bits, by union-find."""
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    values = sorted({p for _, p in prints})
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(b)] = find(a)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return {(i, f"{p:016x}", least.get(find(p))) for i, p in prints}


def test_simhash(spark, odd, empty, docs):
    rows = [(r[0], r[1]) for r in ODD] + [(1000 + r.doc_id, r.text) for r in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == brute_groups([(i, brute_print(t)) for i, t in rows])
    assert simhash.near_duplicates(empty).count() == 0
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["0", "3", "4", "5", "6", "7", "-9", "None"])
    assert near_copies.keep_one(empty).count() == 0


@pytest.mark.parametrize("hot", [2, 64])
def test_link_classes(spark, hot):
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    values = set(base)
    for b in base[:6]:  # chains and clusters around some fingerprints
        x = b
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r.fp: r.label for r in simhash.link_classes(df, hot=hot).collect()}
    signed = {simhash.signed(v): v for v in values}
    groups = defaultdict(set)
    for fp, v in signed.items():
        groups[got.get(fp, fp)].add(v)
    want = defaultdict(set)
    for i, _, c in brute_groups(list(enumerate(values))):
        want[c].add(values[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_index_settings():
    """At each size of the index, links share the guaranteed number of postings, however their bits lie."""
    rng = np.random.default_rng(1)
    seen = set()
    for n in (10, 10**5, 10**7, 10**10):
        sets, least = simhash.masks(n)
        seen.add(len(sets))
        for _ in range(300):
            a = int(rng.integers(-(2**63), 2**63))
            b = a
            for bit in rng.integers(0, 64, 3):
                b ^= simhash.signed(1 << int(bit))
            assert sum(a & m == b & m for m in sets) >= least
    assert seen == {15, 35, 70, 56}


@pytest.mark.parametrize("hot", [256, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    monkeypatch.setattr(components, "HOT_SHARE", 10)
    edges = [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (103, 103), (5, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {i: 200 for i in range(200, 260)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_jaccard(rows):
    """Row number -> smallest row number within reach of five-word Jaccard 0.8."""
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("hot", [2, 64])
def test_near_duplicate_stage(spark, docs, hot):
    rng = np.random.default_rng(5)
    texts = [r[1] for r in ODD] + [r.text for r in docs]
    base = [f"b{x}" for x in rng.integers(0, 10**6, 200)]
    for i in range(60):  # near copies, most of them more than three bits of a SimHash apart
        w = list(base)
        for at in rng.integers(0, 200, rng.integers(1, 9)):
            w[at] = f"c{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_jaccard(texts)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, df, SF) if hot == 64 else near_copies.keep_one(df, hot=hot)
    assert {r.doc_id for r in kept.collect()} == set(want)


@pytest.mark.parametrize("size", [1, 9, 146, 3000])
def test_sketch_keeps_similar_sets(size):
    rng = np.random.default_rng(size)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**64, size, np.uint64))
        y = np.unique(np.r_[x[rng.integers(0, max(len(x) // 4, 1)) :], rng.integers(0, 2**64, rng.integers(0, size // 9 + 1), np.uint64)])
        bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(near_copies.sketch(x), near_copies.sketch(y), strict=True))
        differ = len(set(x.tolist()) ^ set(y.tolist()))
        assert bits <= differ
        if 5 * len(set(x.tolist()) & set(y.tolist())) >= 4 * len(set(x.tolist()) | set(y.tolist())):
            assert 9 * bits <= len(x) + len(y)


def test_postings_hold_numbers_only(spark, monkeypatch):
    """Bitmaps in them would be shuffled once more for every shingle, whole at sizes where a set's rows are no longer neighbours."""
    columns, rows = {}, [(i, " ".join(f"w{j + i // 3 * 40}" for j in range(60 + i % 3))) for i in range(30)]
    write = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, name: columns.setdefault(name, df.columns) and write(df, name))
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 10
    assert sorted(columns["postings"]) == ["i", "id", "k", "posted"]


def shuffled(spark, write, name):
    """How many rows the table of this name has shuffled, and the function that writes tables and counts them."""
    rows = []

    def run(df, at, *more):
        if at != name:
            return write(df, at, *more)
        stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in map(store.apply, range(store.size()))}
        bus, of = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
        listed = lambda: of.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        bus.waitUntilEmpty(30_000)
        store = listed()
        before = stages()
        out = write(df, at, *more)
        bus.waitUntilEmpty(30_000)
        store = listed()
        rows.append(sum(n for k, n in stages().items() if k not in before))
        return out

    return rows, run


def test_only_shared_postings_move(spark, monkeypatch):
    """Where counts are too many to be broadcast (every table here), postings of one fingerprint aren't shuffled to them."""
    monkeypatch.setattr(simhash, "materialize", (found := shuffled(spark, simhash.materialize, "postings"))[1])
    values = [int(x) for x in np.random.default_rng(3).integers(0, 2**62, 2000)]
    df = spark.createDataFrame([(v,) for v in [*values, values[0] ^ 1, values[1] ^ 6]], "fp long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.fp for r in simhash.link_classes(df).collect()} == {values[0], values[0] ^ 1, values[1], values[1] ^ 6}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < found[0][0] < len(simhash.masks(2002)[0]) * 2002 / 5


def test_only_bitmaps_of_pairs_move(spark, monkeypatch):
    """Where pairs are too many to be broadcast, bitmaps of sets that meet no other aren't shuffled to them."""
    monkeypatch.setattr(near_copies, "materialize", (found := shuffled(spark, near_copies.materialize, "pairs"))[1])
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(30))) for i in range(400)]
    rows += [(1000 + i, f"{t} end") for i, t in rows[:5]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(found[0]) < 200


def test_group_around_a_hub_is_not_paired(spark, monkeypatch):
    """Copies of one text that are each near it, but not near one another: each is compared with it, not with all the others."""
    rng = np.random.default_rng(7)
    base = [f"b{x}" for x in rng.integers(0, 10**6, 200)]
    texts = []
    for i in range(160):
        w = list(base)
        for j, at in enumerate(rng.choice(np.arange(5, 195), 3 if i else 0, replace=False)):
            w[at] = f"c{i}_{j}"
        texts.append(" ".join(w))
    assert len(set(brute_jaccard(texts))) == 1
    found, write = {}, near_copies.materialize

    def count(df, name):
        out = write(df, name)
        found.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", count)
    rows = list(enumerate([*texts[1:78], texts[0], *texts[78:]]))
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert sum(found["met"]) <= 4 * len(texts) and found["met"][1] <= len(texts)


def test_links_verified_early(spark, monkeypatch):
    """Pairs verified where they meet give the same classes, and only links are tallied."""
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 2**62))
    values = {base}
    for _ in range(150):
        x = base
        for at in rng.choice(62, rng.integers(1, 7), replace=False):
            x ^= 1 << int(at)
        values.add(x)
    df = spark.createDataFrame([(v,) for v in sorted(values)], "fp long")
    tallied, write = [], simhash.materialize

    def count(df, name):
        out = write(df, name)
        if name == "tallied":
            tallied.append((out.count(), out.where("bit_count(x.fp ^ y.fp) <= 3").count()))
        return out

    monkeypatch.setattr(simhash, "materialize", count)
    late, soon = ({tuple(r) for r in simhash.link_classes(df, hot=2, early=e).collect()} for e in (False, True))
    assert late == soon
    assert tallied[0][0] > tallied[0][1] == tallied[1][0] == tallied[1][1]


def test_keep_one_by_rows(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "xyz")
    rows = [(1, one), (1, two), (2, one), (None, three), (None, three), (None, two), (5, None)]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, one), (1, two), (None, three), (5, None)]))


# 7


def test_token_counts(spark, odd, empty, tmp_path):
    enc = token_counts.encoding(queries.RANKS)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_documents(odd, queries.RANKS).collect())
    assert got == Counter((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in ODD)
    assert token_counts.count_documents(empty, queries.RANKS).count() == 0


def brute_counts(tokens, eod, skip):
    """(start, tokens, closed) of the documents of a file."""
    want, at = [], 0
    for i, t in enumerate([*tokens, None]):
        if t == eod or t is None and i > at:
            want.append((at, i - at - skip, t == eod))
            at = i + 1
    return want


@pytest.mark.parametrize(("eod", "dtype"), [(50256, "<u2"), (0, "<u2"), (9, "<u4")])
def test_token_files(spark, tmp_path, eod, dtype):
    """Files of any length (a prime number of tokens), read by ranges and blocks of few bytes, with bytes that look like
    the separator at another alignment."""
    item, rng = np.dtype(dtype).itemsize, np.random.default_rng(2)
    mark = np.array([eod], dtype).tobytes()
    alphabet = [eod] + [int(np.frombuffer(bytes(x), dtype)[0]) for x in rng.choice(np.frombuffer(mark + b"\1\n", np.uint8), (9, item))]
    for n, last in ((0, 0), (997, eod), (4099, 5)):
        tokens = rng.choice(alphabet, n).astype(dtype)
        tokens[-1:] = last % 256**item
        path = tmp_path / f"{n}-{last}"
        path.mkdir()
        (path / "flat.bin").write_bytes(tokens.tobytes())
        for size, block in (("134217728", 64), ("700", 1)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                found = token_counts.count_tokens(spark, f"file://{path}", eod, dtype, block_bytes=block).collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert sorted((r.start, r.n_tokens, r.closed) for r in found) == brute_counts(tokens.tolist(), eod, 0), (n, last, size)


def test_token_prologues(spark, tmp_path):
    """Prologues across borders of blocks and ranges, with separators that they only seem to hold; null ids."""
    rng = np.random.default_rng(6)
    low = [0xC4 | 0x50 << 8, 0x50C4, 0x5050 & 0x7FFF]  # digits whose bytes make a separator beside one another
    ids = [sum(int(d) << 15 * i for i, d in enumerate(rng.choice(low, 4))) for _ in range(60)] + [None, -1, 0, None, 2**63 - 1]
    docs = [(i, rng.choice([7, 0x50C4, 0xC450 - 1, 0x5050, 0xC4C4], int(rng.integers(0, 40))).tolist()) for i in ids]
    raw = np.array([t for i, body in docs for t in (*token_counts.prologue(i), *body, 50256)], "<u2").tobytes()
    (tmp_path / "flat.bin").write_bytes(raw)
    for size, block in (("134217728", 1), ("64", 1), ("333", 50)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = token_counts.count_tokens(spark, f"file://{tmp_path}", prologue_size=5, block_bytes=block).orderBy("start").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.ident, r.n_tokens) for r in found] == [(i, len(body)) for i, body in docs], size
    (tmp_path / "flat.bin").write_bytes(raw + b"x")
    with pytest.raises(Exception, match="whole tokens"):
        token_counts.count_tokens(spark, f"file://{tmp_path}").collect()


# 8


def brute_base(t):
    w = (t or "").encode().translate(licenses.TABLE).decode().split(" ")
    w = [x for x in w if x]
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, odd, empty, docs):
    texts = [r[1] for r in ODD] + [r.text for r in docs] + ["CC BY-NC 4.0. All rights reserved; cc-by, general  public\nlicense cc by", "accc by", "éall rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        assert tuple(r)[1:6] == brute_base(texts[r.doc_id]) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(odd).count() == len(ODD)


def brute_licences(t):
    """Labels and score by plain search of every phrase and by recursive descent over expressions."""
    import re

    t = t or ""
    w = t.encode().translate(licenses.TABLE).decode().split()
    has = lambda p: any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))
    base = {label for p, label in licenses.BASE.items() if has(p)}
    labels = {label for p, label in licenses.NOTICES.items() if has(p)}
    scores = []

    def grade(n):
        fits = [k for k in licenses.GRADES if n == k or n.startswith(k + "-")]
        return licenses.GRADES[max(fits, key=len)] if fits else 0.5

    def expression(tokens, names):
        def any_of():
            v = all_of()
            while tokens and tokens[0] == "or":
                tokens.pop(0)
                v = max(v, all_of())
            return v

        def all_of():
            v = one()
            while tokens and tokens[0] == "and":
                tokens.pop(0)
                v = min(v, one())
            return v

        def one():
            if not tokens or tokens[0] in ("or", "and", "with", ")"):
                raise SyntaxError
            if (t := tokens.pop(0)) == "(":
                v = any_of()
                if not tokens or tokens.pop(0) != ")":
                    raise SyntaxError
            else:
                names.add(t)
                v = grade(t)
            while tokens and tokens[0] == "with":
                tokens.pop(0)
                kept = set(names)
                one()
                names.clear()
                names.update(kept)
                v = min(1.0, v + 0.1)
            return v

        return any_of()

    if has("spdx license identifier"):
        for line in re.findall(r"spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", t, re.I | re.A):
            tokens, names = [x.lower() for x in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", line, re.A)], set()
            plain = [x for x in tokens if x not in ("and", "or", "with", "(", ")")]
            if not plain:
                continue
            try:
                left = list(tokens)
                v = expression(left, names)
                if left and left[0] in (")", "("):
                    raise SyntaxError
            except SyntaxError:
                v, names = min(map(grade, plain)), set(plain)
            scores.append(v)
            labels |= {n for n in names if n in licenses.KNOWN or n.startswith("licenseref-")}
    every = labels | base
    specific = {n for n in every if not any(m != n and m.startswith(n + "-") for m in every)}
    scores = scores + [grade(n) for n in specific & base] if scores and base else scores or [grade(n) for n in specific]
    return ",".join(sorted(every)), min(scores, default=0.0)


def test_labels_and_scores(spark, docs):
    """Whole texts of the table, and notices and tags of every known licence, against brute force."""
    texts = [None, "", *(r.text for r in docs)]
    texts += [f"Under the {p.title()}, see LICENSE." for p in [*licenses.NOTICES, *licenses.BASE]]
    texts += [f"// SPDX-License-Identifier: {n.upper()}\ncode" for n in sorted(licenses.KNOWN)]
    tags = ["see LICENSE", "LicenseRef-Own AND mit", "(MIT OR GPL-2.0-only) AND BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0 OR Odd", "MIT AND", "(mit", "", "( )", "apache-2.0 # c", "mit ) or"]
    texts += [f"spdx-license-identifier: {e}\nSPDX-License-Identifier:\t{f}\n all rights reserved"[: None if i % 2 else -20] for i, e in enumerate(tags) for f in tags]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in licenses.scan_licenses(df).collect():
        labels, score = brute_licences(texts[r.doc_id])
        assert (r.labels, r.score) == (labels, pytest.approx(score)), texts[r.doc_id][-300:]
    assert "see" not in {n for r in licenses.scan_licenses(df).collect() for n in r.labels.split(",")}
    assert len(licenses.KNOWN) > 200 and len(licenses.NOTICES) > 300


@pytest.mark.parametrize(
    ("expression", "score", "names"),
    [
        ("MIT", 1.0, {"mit"}),
        ("GPL-3.0-only OR MIT", 1.0, {"gpl-3.0-only", "mit"}),
        ("GPL-2.0 AND MIT OR Apache-2.0", 1.0, {"gpl-2.0", "mit", "apache-2.0"}),
        ("GPL-2.0 AND (MIT OR Apache-2.0)", 0.4, {"gpl-2.0", "mit", "apache-2.0"}),
        ("GPL-2.0 WITH Classpath-exception-2.0", 0.5, {"gpl-2.0"}),
        ("Odd-1.0 comment after", 0.5, {"odd-1.0"}),
    ],
)
def test_expressions(expression, score, names):
    got = licenses.evaluate(licenses.parse(expression))
    assert got[0] == pytest.approx(score) and got[1] == names


def test_bad_expressions():
    assert [licenses.parse(e) for e in ("", "AND MIT", "(MIT", "MIT)", "MIT OR")] == [None] * 5
    tagged = licenses.scan(b"x\n# SPDX-License-Identifier: (GPL-2.0 OR MIT)\n", licenses.automaton())
    assert tagged[5] == "gpl-2.0,mit" and tagged[6] == 1.0


# 9


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 500 + ["b"] * 60 + [None] * 5 + ["c"] * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    size, took, target = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r._size
        took[r.source] += r._size * r._times
        target[r.source] = r._target
        assert 0 <= r._times <= 3
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(took[s] - target[s]) <= 7 and target[s] <= 3 * size[s] + 1e-9 for s in size)
    assert {r.doc_id: r._times for r in mixing.mix(df).collect()} == {r.doc_id: r._times for r in out}
    assert mixing.mix(odd).select(*odd.columns).count() == len(ODD)
    assert mixing.mix(empty).count() == 0


def brute_mix(rows, weights=(5, 2, 1)):
    """(id, text, source) -> how often each row is taken, by sorting; and the sources' targets."""
    from fractions import Fraction

    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(size.values())
    while True:
        rest_w = sum(w[s] for s in names if s not in capped)
        level = Fraction(total - sum(3 * size[s] for s in capped), rest_w) if rest_w else 0
        more = {s for s in names if s not in capped and 3 * size[s] <= level * w[s]}
        if not more:
            break
        capped |= more
    target = {s: Fraction(3 * size[s]) if s in capped else level * w[s] for s in names}
    times = []
    hashes = [int(hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    cut = {}
    for s in names:
        whole = min(3, target[s] // size[s]) if size[s] else 0
        by, at = Counter(), Fraction(0)
        for h, (_, t, src) in zip(hashes, rows, strict=True):
            if src == s:
                by[h] += len(words(t))
        budget, below = target[s] - whole * size[s], -1
        for h in sorted(by):
            if at >= budget or at + by[h] - budget >= budget - at and at + by[h] > budget:
                break
            at, below = at + by[h], h
        cut[s] = (whole, below)
    for h, (_, _, s) in zip(hashes, rows, strict=True):
        times.append(min(3, cut[s][0] + (h <= cut[s][1])))
    return times, target


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_mixing_by_sorting(spark, monkeypatch, broadcast):
    """Against brute force, with more sources than are broadcast, equal and null ids, and a source of one row's copies."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rng = np.random.default_rng(4)
    rows = [(int(i), "w " * int(rng.integers(1, 9)), f"s{int(rng.integers(0, 300)) ** 2 // 300}") for i in range(1500)]
    rows += [(None, f"w{i} " * 3, None) for i in range(90)] + [(1, f"v{i}", "one id") for i in range(90)] + [(5, "copy", "z")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times, target = brute_mix(rows)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.text, r.source, r._times) for r in got) == Counter((*r, int(n)) for r, n in zip(rows, times, strict=True))
    assert all(r._target == pytest.approx(float(target[r.source])) for r in got)


def test_many_sources(spark):
    """More sources than the engine broadcasts: targets are whole, and none above its cap."""
    df = spark.range(200_000).select(F.concat(F.lit("host"), "id").alias("source"), (1 + F.col("id") % 50).alias("source_size"))
    t = mixing.targets(df)
    total, dealt, over, n = t.agg(F.sum("source_size"), F.sum("target"), F.max(F.col("target") - 3 * F.col("source_size")), F.count("*")).first()
    assert n == 200_000 and dealt == pytest.approx(total) and over <= 1e-6


def test_nested_thresholds(spark):
    rows = spark.range(2000).select(F.lit("s").alias("source"), mixing.row_hash(F.col("id"), F.lit("")).alias("h"), (F.col("id") % 9).alias("size"))
    budgets = spark.createDataFrame([("s", "small", 100.0), ("s", "large", 3000.0), ("s", "all", 9e9), ("s", "none", 0.0)], "source string, name string, budget double")
    cut = {r.name: r.threshold for r in mixing.thresholds(rows, budgets).collect()}
    taken = {k: rows.where(F.col("h") < v).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for k, v in cut.items()}
    assert abs(taken["small"] - 100) <= 8 and abs(taken["large"] - 3000) <= 8 and taken["none"] == 0 and taken["all"] >= 7900
    assert cut["none"] <= cut["small"] <= cut["large"] <= cut["all"]


# 10


def test_fold(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "c"), (1, 1, 5, "delta", None, "d"), (1, 0, 6, "edit", None, "hello"), (2, 0, 0, "edit", "user", "x"), (None, 0, 0, "message", None, None)]
    df = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat_format.fold(df).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "cd")], 2: [("user", "x")], None: [("", "")]}
    assert chat_format.fold(df.limit(0)).count() == 0


def test_fold_by_replay(spark):
    """Random logs against a replay of their events one by one."""
    rng = np.random.default_rng(9)
    log = []
    for c in range(30):
        for n in rng.permutation(60).tolist():
            log.append((c, int(rng.integers(0, 4)), n, str(rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])), str(rng.choice(["user", "assistant"])), str(rng.integers(0, 99))))
    want = {}
    for c, m, _, kind, role, text in sorted(log):
        done = want.setdefault(c, {}).setdefault(m, [])
        if kind == "message" or not done:
            done.append([role, "" if kind == "regenerate" else text])
        else:
            done[-1][1] = done[-1][1] + text if kind == "delta" else text if kind == "edit" else ""
    df = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {r.conv_id: [list(m) for m in r.messages] for r in chat_format.fold(df).collect()}
    assert got == {c: [x for m in sorted(ms) for x in ms[m]] for c, ms in want.items()}


def test_events(spark):
    """Rows come back from their events: odd texts, repeated rows and turns, null ids."""
    texts = [None, "", "a", "ab", "abc", "é\U0001f600日", "x" * 1001, "<|im_end|>\\"]
    rows = [(c, t % 3, "user", x) for c in (1, 2, None) for t, x in enumerate(texts)] + [(7, 0, "user", "same")] * 3 + [(7, None, None, "b"), (7, None, None, "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat_format.as_events(df)
    assert {r.kind for r in events.where("conv_id = 7").collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat_format.fold(events).collect()}
    for c in (1, 2, None, 7):
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        assert got[c] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
    assert chat_format.fold(chat_format.as_events(df.limit(0))).count() == 0


def test_render(spark):
    nasty = ["", "<|im_end|>", "<\\|im_start|>", "<\\\\|", "\\", "a\n<|im_start|>assistant\nb", "<<||>>", "\n", "é\U0001f600", "<\\n>", "\\<|"]
    rows = [(i, 0, 0, "message", r, t) for i, t in enumerate(nasty) for r in ("user",)] + [(i, 1, 1, "message", "assistant", t) for i, t in enumerate(nasty)] + [(i, 2, 2, "message", t, "end") for i, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.render(chat_format.fold(df))).collect()}
    for i, t in enumerate(nasty):
        assert [tuple(m) for m in out[i].messages] == [("user", t), ("assistant", t), (t, "end")] and out[i].loss_texts == [t]
        assert out[i].formatted.count(chat_format.START) == 3 and out[i].formatted.count(chat_format.END) == 3
    d = {r.conv_id: r for r in chat_format.digest(chat_format.render(chat_format.fold(df))).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(nasty[1].encode()).hexdigest() and d[1].n_turns == 3


# the pipeline


def brute_kept(docs):
    """Ids that the quality rules keep: rates of each host and rule, shrunk by the rule's beta prior."""
    fails = {}
    for r in docs:
        n, chars, symbols, dup, again = brute_measures(r.text)
        lines = sum(1 for s in (r.text or "").split("\n") if s.encode().strip())
        fails[r.doc_id] = (n < 10 or 100 * again > 20 * n, 10 * symbols > n, 10 * dup > 3 * lines, chars < 2 * n or chars > 12 * n)
    pages = Counter(r.source for r in docs)
    bad = defaultdict(set)
    for rule in range(4):
        failed = Counter(r.source for r in docs if fails[r.doc_id][rule])
        m = sum(failed.values()) / len(docs)
        v = sum(n * (failed[h] / n - m) ** 2 for h, n in pages.items()) / len(docs) - m * (1 - m) * len(pages) / len(docs)
        weight = min(max(m * (1 - m) / max(v, 1e-12) - 1, 1), 1000)
        for h, n in pages.items():
            if (failed[h] + m * weight) / (n + weight) > 0.5:
                bad[h].add(rule)
    return {r.doc_id for r in docs if not fails[r.doc_id][0] and not any(fails[r.doc_id][k] and bad[r.source] & {0, k} for k in (1, 2, 3))}


def test_pipeline(spark, docs):
    """Each stage against brute force over what the stage before it kept."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    current = spark.read.parquet(f"{SF}/documents.parquet")
    columns = current.columns
    rows = {r.doc_id: r for r in docs}
    one = corpus_pipeline.STAGES[0][1](spark, current, SF)
    ids = {r.doc_id for r in one.collect()}
    assert one.columns == columns and ids == brute_kept(docs)
    two = corpus_pipeline.STAGES[1][1](spark, one, SF)
    pages, held = Counter(rows[i].source for i in ids), Counter()
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
    for i in ids:
        held.update((rows[i].source, s) for s in {strip(s) for s in rows[i].text.split("\n")} - {""})
    gone = {k for k, n in held.items() if n >= 5 and n > 0.1 * pages[k[0]]}
    want = {i: "\n".join(s for s in rows[i].text.split("\n") if (rows[i].source, strip(s)) not in gone) for i in ids}
    assert {r.doc_id: r.text for r in two.collect()} == want and two.columns == columns
    three = corpus_pipeline.STAGES[2][1](spark, two, SF)
    order = sorted(want)
    left = {order[i] for i in brute_jaccard([want[i] for i in order])}
    assert {r.doc_id for r in three.collect()} == left and three.columns == columns
    four = corpus_pipeline.STAGES[3][1](spark, three, SF)
    mixed = [(i, want[i], rows[i].source) for i in sorted(left)]
    times = Counter({i: int(n) for (i, *_), n in zip(mixed, brute_mix(mixed)[0], strict=True) if n})
    assert Counter(r.doc_id for r in four.collect()) == times and four.columns == columns
    five = corpus_pipeline.STAGES[4][1](spark, four, SF).collect()
    assert Counter(r.doc_id for r in five) == times
    assert all(r.ids == sp.encode(want[r.doc_id]) and r.n_tokens == len(r.ids) for r in five)
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in found) == sorted((r.doc_id, tuple(r.ids)) for r in five)
