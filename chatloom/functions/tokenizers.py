"""Tokenizers that tell where their tokens lie, and masks of tokens by spans, over whole Arrow batches.

A tokenizer is a function from a batch of texts to tokens: offsets in code points, from 0,
end exclusive, of each text. ``by_blanks`` is built in; ``byte_pairs`` reads a public
vocabulary of ranks; any other that gives byte or code point offsets fits in their place.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
SPANS = "array<struct<start:int,stop:int>>"
#: From texts to token starts and stops (bytes of the batch's text data, ascending).
Tokenizer = Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins and the last ends."""
    large = texts.cast(pa.large_string())
    if large.offset or large.null_count:
        large = pa.concat_arrays([large.fill_null("")]) if large.null_count else pa.concat_arrays([large.slice(0)])
    edges = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    raw = large.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None and len(large) else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def by_blanks(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Words between blanks: found by one comparison of the batch's bytes."""
    data, edges = text_bytes(texts)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = data != 0x20
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True  # a text's first byte begins a token, whatever is before it
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first))
    stops = np.flatnonzero(before & (~inside | first))
    return starts, stops


@functools.lru_cache(2)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str, pattern: str = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") -> Tokenizer:
    """Byte pair encoding by a file of ranks that all executors can open; tokens may end within a character."""

    def run(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        made = _ranks(path, pattern)
        lengths = [len(b) for t in texts.to_pylist() for b in made.decode_tokens_bytes(made.encode_ordinary(t or ""))]
        stops = np.cumsum(np.array(lengths, np.int64))
        return stops - np.array(lengths, np.int64), stops

    return run


def token_offsets(text: Column, tokenizer: Tokenizer = by_blanks) -> Column:
    """array<struct<start, stop>> of each text's tokens in code points; a null text has none.

    A token that ends within a character's bytes covers that character, as does the next one.
    """

    def run(texts: pa.Array) -> pa.Array:
        data, edges = text_bytes(texts)
        starts, stops = tokenizer(texts)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points that begin before a byte
        of = np.searchsorted(edges, starts, "right") - 1
        base = points[edges[of]]
        begins_inside = np.r_[(data & 0xC0) == 0x80, False]
        start = points[starts] - begins_inside[starts] - base
        counts = np.bincount(of, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array((points[stops] - base).astype(np.int32))], fields=list(SPAN))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)

    return F.arrow_udf(run, SPANS)(text).alias("tokens")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of all spans of a list array; a null list or span has none."""
    spans = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if not lists.null_count else [0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()])
    return rows, spans.field("start").to_numpy(zero_copy_only=False).astype(np.int64), spans.field("stop").to_numpy(zero_copy_only=False).astype(np.int64)


def within(tokens: Column, spans: Column) -> Column:
    """array<int>: 1 for each token that lies wholly within one of the spans, which may overlap and come in any order.

    Spans are sorted and each token is looked up once: of the spans that begin at or before
    it, does the one that reaches furthest reach its end? Null tokens give null; null spans
    are none.
    """

    def run(tokens: pa.Array, spans: pa.Array) -> pa.Array:
        row, start, stop = _flat(tokens)
        srow, sstart, sstop = _flat(spans)
        width = int(max(stop.max(initial=0), sstop.max(initial=0), start.max(initial=0), sstart.max(initial=0))) + 2
        key, reach = srow * width + sstart, srow * width + sstop
        order = np.argsort(key, kind="stable")
        key, furthest = key[order], np.maximum.accumulate(reach[order]) if len(order) else reach
        at = np.searchsorted(key, row * width + start, "right") - 1
        hit = np.zeros(len(row), np.int32)
        on = at >= 0
        hit[on] = (furthest[at[on]] >= row[on] * width + stop[on]) & (srow[order][at[on]] == row[on])
        counts = np.bincount(row, minlength=len(tokens)) if len(row) else np.zeros(len(tokens), np.int64)
        edges = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return pa.ListArray.from_arrays(edges, pa.array(hit), mask=tokens.is_null() if tokens.null_count else None)

    return F.arrow_udf(run, "array<int>")(tokens, spans).alias("mask")
