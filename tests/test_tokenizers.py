"""Token offsets of two tokenizers, and masks by spans, against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import tokenizers
from chatloom.operators import masks

RANKS = os.path.join(os.environ.get("CHATLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
TEXTS = ["one two", "", None, "  lead and  double ", "é日本 \U0001f600x y", "x", " ", "tab\tand\nline", "Ünïcode wörds " * 50, None]


def plain(rows):
    return [None if r is None else [tuple(x) for x in r] for r in rows]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def test_words(spark, texts):
    got = texts.select("i", masks.blank_tokens(F.col("t")).alias("k")).orderBy("i").collect()
    assert plain(r.k for r in got) == [[m.span() for m in re.finditer("[^ ]+", t or "")] for t in TEXTS]
    assert texts.limit(0).select(masks.blank_tokens(F.col("t"))).count() == 0
    long = spark.createDataFrame([("é " * 300_000,)], "t string").select(F.size(masks.blank_tokens(F.col("t"))).alias("n"))
    assert long.first().n == 300_000


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_byte_pairs(spark, texts):
    """Tokens' texts are the text again; offsets within a character are the character's."""
    tokenizer = tokenizers.byte_pairs(RANKS)
    got = texts.select("i", masks.blank_tokens(F.col("t"), tokenizer).alias("k")).orderBy("i").collect()
    for t, k in zip(TEXTS, plain(r.k for r in got), strict=True):
        points = set()
        for a, b in k:
            assert 0 <= a <= b <= len(t)
            points |= set(range(a, b))
        assert points == set(range(len(t or "")))
        assert all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(k, k[1:], strict=False))
    assert "".join(TEXTS[0][a:b] for a, b in plain([got[0].k])[0]) == TEXTS[0]


def test_within(spark):
    rnd = random.Random(4)
    span = lambda: (a := rnd.randint(0, 30), a + rnd.randint(0, 9))
    rows = [(i, sorted(span() for _ in range(rnd.randint(0, 12))), [span() for _ in range(rnd.randint(0, 5))]) for i in range(300)]
    rows += [(300, None, [(0, 5)]), (301, [(0, 1)], None), (302, [], [])]
    df = spark.createDataFrame(rows, f"i int, t {tokenizers.SPANS}, s {tokenizers.SPANS}").repartition(3)
    got = {r.i: r.k for r in df.select("i", masks.token_mask(F.col("t"), F.col("s")).alias("k")).collect()}
    for i, t, s in rows:
        assert got[i] == (None if t is None else [int(any(c <= a and b <= d for c, d in s or [])) for a, b in t])
