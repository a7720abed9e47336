"""Native text functions."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from chatloom.functions.schemas import CANDIDATE, NOT_SECRET

#: Blanks as queries and their SQL agree on them.
BLANKS = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the phrases, lower-cased."""
    low = F.lower(c)
    hits = [F.contains(low, F.lit(p.lower())) for p in phrases]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def matching_form(c: Column) -> Column:
    """Quotes alike, written line feeds real, blanks collapsed, trimmed."""
    c = F.replace(F.replace(c, F.lit("'"), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return strip(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def distinct_ratio(c: Column) -> Column:
    return F.size(F.array_distinct(chars(c))) / F.length(c)


def looks_random(c: Column) -> Column:
    return (F.length(c) >= 8) & (distinct_ratio(c) > 0.7)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for fewer than 8."""
    n = F.length(c)
    share = F.transform(F.array_sort(F.array_distinct(chars(c))), lambda x: (n - F.length(F.replace(c, x, F.lit("")))).cast("double") / n)
    total = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.ln(p) / F.ln(F.lit(2.0)))
    return F.when(n < 8, F.lit(0.0)).otherwise(total)


def secret_score(token: Column, ent: Column) -> Column:
    """How likely a token is a secret, 0 to 1; it counts as one above 0.5. Terms are added in this order, as doubles."""
    kinds = sum((token.rlike(p).cast("int") for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    n = F.length(token)
    d = lambda x: F.lit(float(x))
    score = F.when(ent > 5.5, d(0.4)).when(ent > 4.5, d(0.25)).otherwise(d(0))
    score = score + F.when(kinds >= 3, d(0.3)).when(kinds >= 2, d(0.15)).otherwise(d(0))
    score = score + F.when(n > 40, d(0.2)).when(n > 30, d(0.1)).otherwise(d(0))
    score = score + F.when(token.rlike(r"^[A-Za-z0-9_\-]+$"), d(0.1)).otherwise(d(0))
    score = score - F.when(contains_any(token, NOT_SECRET), d(0.5)).otherwise(d(0))
    score = score - F.when(F.lower(token).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), d(0.3)).otherwise(d(0))
    never = (n < 20) | token.rlike("^([A-Za-z]+|[0-9]+)$")
    return F.when(never, d(0)).otherwise(score)


def candidates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CANDIDATE})"), F.lit(1))


def line_of(c: Column, part: Column) -> Column:
    """Number, from 1, of the line where ``part`` first occurs."""
    return F.size(F.split(F.substr(c, F.lit(1), F.instr(c, part) - 1), "\n"))


def masked(x: Column) -> Column:
    """First and last four characters and asterisks between, or [REDACTED] for 12 characters or fewer."""
    n = F.length(x)
    stars = F.concat(F.substr(x, F.lit(1), F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(x, F.lit(4)))
    return F.when(n > 12, stars).otherwise(F.lit("[REDACTED]"))


def context(c: Column, at: Column, size: int = 50) -> Column:
    """Text around position ``at`` (from 1), ``size`` characters to either side."""
    start = F.greatest(at - size, F.lit(1))
    return F.substr(c, start, at + size - start)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(c)


def mask_words(c: Column, secret_type: Column, value: Column) -> Column:
    """Every word that looks random and is long, or names the secret's type, masked; blanks collapse."""
    n = F.length
    hit = lambda w: looks_random(w) & ((n(w) > 20) | ((n(w) > 15) & F.contains(F.lower(w), F.lower(secret_type))))
    return F.array_join(F.transform(words(c), lambda w: F.when(hit(w), value).otherwise(w)), " ")


def model_size(name: Column) -> Column:
    """Billions of parameters that a model's name tells, else 1.5."""
    number = F.regexp_extract(name, r"(\d+\.?\d*)[Bb]", 1)
    known = F.when(number != "", number.cast("double"))
    for part, size in (("0.5", 0.5), ("1.5", 1.5), ("3", 3.0), ("7", 7.0)):
        known = F.coalesce(known, F.when(F.contains(name, F.lit(part)), F.lit(size)))
    return F.coalesce(known, F.lit(1.5))


def display_name(name: Column) -> Column:
    """A checkpoint's name for display: its prefix gone, words with capitals."""
    bare = F.replace(F.replace(name, F.lit("checkpoints_")), F.lit("checkpoint_"))
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in function has it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(IntegerType())
def fuzzy_find(text: pd.Series, pattern: pd.Series, start: pd.Series) -> pd.Series:
    """Offset of the earliest window with the largest share of equal positions, or -1 below 0.85."""

    def one(t: str | None, p: str | None, at: int) -> int:
        if not t or not p or at + len(p) > len(t):
            return -1
        codes = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
        whole, part = codes(t)[at:], codes(p)
        equal = np.zeros(len(whole) - len(part) + 1, np.int64)
        for i, c in enumerate(part):
            equal += whole[i : i + len(equal)] == c
        best = int(equal.argmax())
        return at + best if equal[best] / len(part) >= 0.85 else -1

    return pd.Series([one(*r) for r in zip(text, pattern, start, strict=True)], dtype="int32")
