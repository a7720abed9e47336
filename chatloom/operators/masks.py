"""Loss masks of messages, characters and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions import tokenizers
from chatloom.functions.schemas import LOSS_MASK, SEGMENT


def loss_mask(messages: Column | str) -> Column:
    """Indices to train on (assistant messages), indices to ignore, and a segment per message."""
    segments = F.transform(messages, lambda m, i: F.struct(i.alias("index"), m.role.alias("role"), F.coalesce((m.role == "assistant").cast("int"), F.lit(0)).alias("mask")))
    at = lambda on: F.transform(F.filter(segments, lambda s: s["mask"] == on), lambda s: s["index"])
    return F.struct(at(1).alias("train_indices"), at(0).alias("ignore_indices"), segments.alias("segments")).cast(LOSS_MASK)


def auto_segments(messages: Column | str, segments: Column) -> Column:
    """Given segments, or, where there are none, segments by role; an empty answer isn't trained on."""
    def made(m: Column, i: Column) -> Column:
        answers = F.lower(T.strip(m.role)).isin("assistant", "bot", "ai") & (T.strip(F.coalesce(m.content, F.lit(""))) != "")
        return F.struct(i.alias("index"), m.role.alias("role"), F.coalesce(answers, F.lit(False)).cast("int").alias("mask"))

    return F.when(F.size(segments) > 0, segments).otherwise(F.transform(messages, made).cast(f"array<{SEGMENT}>"))


def char_mask(messages: Column | str) -> Column:
    """A 1 or 0 for each character of all contents."""
    return F.flatten(F.transform(messages, lambda m: F.array_repeat((m.role == "assistant").cast("int"), F.length(F.coalesce(m.content, F.lit(""))))))


def blank_tokens(text: Column, tokenizer: tokenizers.Tokenizer = tokenizers.by_blanks) -> Column:
    """Offsets (from 0, end exclusive) of a text's tokens: blank-separated words, or what another tokenizer gives."""
    return tokenizers.token_offsets(text, tokenizer)


SPANS = "array<struct<start:int,stop:int>>"


def trained_spans(text: Column, messages: Column | str) -> Column:
    """Where the trained messages' texts lie in a text in matching form, each sought from the end of the one before; one
    that isn't found doesn't advance the search."""
    wanted = F.transform(F.filter(messages, lambda m: m.role == "assistant"), lambda m: T.matching_form(F.coalesce(m.content, F.lit(""))))
    seed = F.struct(F.lit(1).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(s: Column, w: Column) -> Column:
        hit = F.call_function("locate", w, text, s["at"])
        found = (w != "") & (hit > 0)
        stop = hit - 1 + F.length(w)
        return F.struct(F.when(found, stop + 1).otherwise(s["at"]).alias("at"), F.when(found, F.concat(s["out"], F.array(F.struct((hit - 1).alias("start"), stop.alias("stop"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(wanted, seed, step, lambda s: s["out"])


def token_mask(tokens: Column, spans: Column) -> Column:
    """1 for tokens wholly within a span: a merge of sorted spans and tokens, not every token against every span."""
    return tokenizers.within(tokens, spans)


def tail_mask(n: Column) -> Column:
    """The mask where offsets don't fit the tokens: 0 for the first quarter, then 1."""
    start = F.least(F.floor(n / 4), n - 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i >= start).cast("int"))
