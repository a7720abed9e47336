"""Quality classifier by co-training on two views of a document.

The text view sees hashed words and the shape of the text; the metadata view sees the
source, the language and the recorded length. Each view's classifier is fitted to the
labelled rows; over some rounds each then labels all the rows that it is sure about, for the
other view to learn from. Both are calibrated on held-out labelled rows and combined by
weights fitted there, and all documents are scored.

Every round scores every document that isn't fitted to, on the executors, and the other
view learns from each of the confident ones: in each of PASSES passes the executors sum the
gradient of the view's loss over them, by pseudo-label, and a bound of its curvature by
component; the driver then finds the weights that are best for the labelled rows and that
quadratic bound together. The loss falls with every pass. What goes to the driver is a few
numbers for each component of the features, whatever the number of documents.

Bound: the labelled rows fitted to are MAX_LABELLED at most, those with the smallest hashes
of their ids; their features, never their texts, go to the driver. Labelled rows beyond
that are documents like any other.

Features are taken from the texts once, into a table in the shared folder.

Cases: a null text is empty; null or unseen sources and languages and null lengths
have buckets of their own. A document with several labels takes their majority, ties
to 1; null labels don't count. With no label, or labels of one class only, every score
is the smoothed share of that class (0.5 without labels). Repeated rows are scored and
pseudo-labelled one by one; rows that repeat a labelled id are fitted as one. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import materialize

MAX_LABELLED = 4000
BUCKETS = 2048
SHAPE = 8
META_BUCKETS = 512
LENGTHS = 24
ROUNDS = 4
#: A pseudo-label needs so much confidence, and weighs so much beside a label; all together weigh so much beside all labels.
CONFIDENT, PSEUDO_WEIGHT, PSEUDO_SHARE = 0.9, 0.5, 0.5
#: Passes over the confident documents in a round.
PASSES = 3
KEEP = 0.5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLOCK = 1 << 16
#: Labelled ids that are broadcast at most (some 20 bytes each).
BROADCAST_LABELS = 1_000_000


def text_counts(text: bytes | None) -> tuple[bytes, bytes, bytes]:
    """The buckets of a text's words and how many words each has (<u2 and <u4), and SHAPE numbers about its form (<f4)."""
    raw = (text or b"")
    words = raw.translate(LOWER).split()
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK]
        counts += np.bincount(np.fromiter(map(zlib.crc32, part), np.int64, len(part)) & BUCKETS - 1, minlength=BUCKETS)
    n, size = len(words), max(1, len(raw))
    symbols = size - len(raw.translate(None, b"#*$%&|<>{}[]=_@"))
    digits = size - len(raw.translate(None, b"0123456789"))
    capitals = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = raw.split(b"\n")
    shape = (
        math.log1p(n) / 10,
        len(raw) / max(1, n) / 10,
        len(set(words)) / max(1, n),
        10 * min(1.0, symbols / size),
        10 * min(1.0, digits / size),
        10 * min(1.0, capitals / size),
        len(set(lines)) / len(lines),
        float(n < 10),
    )
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes(), np.array(shape, "<f4").tobytes()


class TextRows:
    """The text view of some rows: hashed word weights of length 1 together, then SHAPE numbers; kept sparse."""

    def __init__(self, buckets: list[bytes], counts: list[bytes], shapes: list[bytes]) -> None:
        self.n = np.array([len(b) // 2 for b in buckets], np.int64)
        self.row = np.repeat(np.arange(len(buckets)), self.n)
        self.at = np.frombuffer(b"".join(buckets), "<u2").astype(np.int64)
        value = np.log1p(np.frombuffer(b"".join(counts), "<u4").astype(np.float64))
        length = np.sqrt(np.bincount(self.row, value * value, len(buckets)))
        self.value = (value / np.maximum(length, 1e-6)[self.row]).astype(np.float32)
        self.shape = np.frombuffer(b"".join(shapes), "<f4").reshape(-1, SHAPE)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self.n)) + self.shape @ w[BUCKETS:-1] + w[-1]

    def weighed(self, e: np.ndarray) -> np.ndarray:
        """The sum of the rows' features, and last of 1, each row by its weight."""
        return np.r_[np.bincount(self.at, self.value * e[self.row], BUCKETS), e @ self.shape, e.sum()]

    def lengths(self) -> np.ndarray:
        """Sums of a row's features, none of which is negative, and 1."""
        return np.bincount(self.row, self.value, len(self.n)) + self.shape.sum(axis=1) + 1

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.n), BUCKETS + SHAPE), np.float32)
        out[self.row, self.at] = self.value
        out[:, BUCKETS:] = self.shape
        return out


class MetaRows:
    """The metadata view of some rows: three features each that are one."""

    def __init__(self, buckets: np.ndarray) -> None:
        self.at = buckets.reshape(-1, 3).astype(np.int64)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return w[self.at].sum(axis=1) + w[-1]

    def weighed(self, e: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.at.ravel(), np.repeat(e, 3), META), e.sum()]

    def lengths(self) -> np.ndarray:
        return np.full(len(self.at), 4.0)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.at), META), np.float32)
        out[np.arange(len(self.at))[:, None], self.at] = 1
        return out


def meta_buckets(source: str | None, lang: str | None, length: int | None) -> tuple[int, int, int]:
    """The three features of the metadata view that are one: source, language and length class."""
    a = zlib.crc32(b"s" + source.encode()) % (META_BUCKETS - 1) + 1 if source is not None else 0
    b = META_BUCKETS + (zlib.crc32(b"l" + lang.encode()) % 63 + 1 if lang is not None else 0)
    c = META_BUCKETS + 64 + (0 if length is None else 1 + min(LENGTHS - 2, int(math.log2(1 + max(0, length)))))
    return a, b, c


META = META_BUCKETS + 64 + LENGTHS


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Tilt:
    """A quadratic bound of a loss around weights ``at``: its gradient there, curvature by component, and total weight."""

    at: np.ndarray
    gradient: np.ndarray
    curve: np.ndarray
    weight: float


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 150, tilt: Tilt | None = None) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression, by Nesterov's accelerated gradient; with ``tilt``, of the
    rows' loss and that bound together."""
    w = np.zeros(x.shape[1] + 1, np.float64) if tilt is None else tilt.at.copy()
    v = w.copy()
    total = weight.sum() + (tilt.weight if tilt else 0.0)
    # the loss curves by a quarter of the mean squared length of a row at most
    step = 1 / (0.25 * (1 + float((weight * (x.astype(np.float64) ** 2).sum(axis=1)).sum() / total)) + l2 + (tilt.curve / total if tilt else 0.0))
    for i in range(steps):
        e = weight * (sigmoid(x @ v[:-1].astype(np.float32) + v[-1]) - y) / total
        g = np.r_[e.astype(np.float32) @ x + l2 * v[:-1], e.sum()]
        if tilt:
            g = g + (tilt.gradient + tilt.curve * (v - tilt.at)) / total
        new = v - step * g
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: Slope and intercept that calibrate each view, and the combination of calibrated logits.
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    mix: tuple[float, float, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of quality by each view and by both, from raw logits."""
        a = self.text_cal[0] * text + self.text_cal[1]
        b = self.meta_cal[0] * meta + self.meta_cal[1]
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def constant(share: float) -> Model:
    logit = math.log(share / (1 - share))
    return Model(np.zeros(BUCKETS + SHAPE + 1), np.zeros(META + 1), (1.0, logit), (1.0, logit), (0.5, 0.5, 0.0))


def confident(logits: np.ndarray) -> np.ndarray:
    """The label that a view gives each row that it is sure about; -1 for the others."""
    p = sigmoid(logits)
    return np.where(np.maximum(p, 1 - p) >= CONFIDENT, (p >= 0.5).astype(int), -1)


@dataclass
class Labelled:
    """The rows that are fitted to: dense features of both views, labels, and which rows are held out to calibrate."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> Labelled:
        held = np.arange(len(y)) % 5 == 4  # the last of each five
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        return cls((text, meta), y, held)

    def learn(self, view: int, now: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
        """The view's weights, from the labelled rows and from the rows that the other view is sure about: by label, their
        number, gradient and curvature (rows of ``sums``) at the weights ``now``.

        The classes' weights among the pseudo-labels follow the labels' shares.
        """
        train = ~self.held
        y, share = self.y[train], self.y[train].mean()
        tilt = None
        if sums is not None:
            tilt = Tilt(now, np.zeros(len(now)), np.zeros(len(now)), 0.0)
            for label, part in ((0, 1 - share), (1, share)):
                if (n := sums[label, 0, 0]) > 0:
                    weight = min(PSEUDO_SHARE * len(y) * part, PSEUDO_WEIGHT * n)
                    tilt.gradient += weight / n * sums[label, 1]
                    tilt.curve += weight / n * sums[label, 2]
                    tilt.weight += weight
        return fit(self.views[view][train], y, np.ones(len(y)), tilt=tilt)

    def calibrated(self, w: list[np.ndarray]) -> Model:
        on = self.held if self.held.any() else ~self.held
        y, ones = self.y[on], np.ones(on.sum())
        logits = [self.views[i][on] @ w[i][:-1].astype(np.float32) + w[i][-1] for i in (0, 1)]
        cal = [fit(z[:, None].astype(np.float32), y, ones, l2=1e-4, steps=500) for z in logits]
        both = np.stack([c[0] * z + c[1] for c, z in zip(cal, logits, strict=True)], axis=1).astype(np.float32)
        return Model(w[0], w[1], tuple(map(float, cal[0])), tuple(map(float, cal[1])), tuple(map(float, fit(both, y, ones, steps=500))))


COLUMNS = ("text", "source", "lang", "n_chars")
#: Rows that are held as Python objects at once.
STEP = 256


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row, in the shared folder: wb, wc (words), sh (shape), mb (metadata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                words = zip(*(text_counts(t) for t in part.column(1).to_pylist()), strict=True)
                meta = [np.array(meta_buckets(*r), "<i4").tobytes() for r in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in (*words, meta)]], ["doc_id", "wb", "wc", "sh", "mb"])

    inputs = docs.select("doc_id", F.col("text").cast("binary"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return materialize(inputs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, wb binary, wc binary, sh binary, mb binary"), "features")


def views(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch, TextRows, MetaRows]]:
    """Parts of batches with their two views; the columns wb, wc, sh and mb stand from ``first`` on."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            wb, wc, sh, mb = (part.column(first + i).to_pylist() for i in range(4))
            yield part, TextRows(wb, wc, sh), MetaRows(np.frombuffer(b"".join(mb), "<i4"))


def pseudo_sums(rows: DataFrame, fitted: DataFrame, sure: list[np.ndarray], now: list[np.ndarray]) -> list[np.ndarray]:
    """For each view, by the label that the other view, of the weights ``sure``, gives: the number (in all components), the
    gradient at ``now`` and the curvature of the rows that it is sure about and that aren't fitted to. 2 by 3 by components."""
    widths = [len(w) for w in now]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, 3, n)) for n in widths]
        for part, *xs in views(batches, 0):
            keep = np.array([f is None for f in part.column(4).to_pylist()])
            for i, x in enumerate(xs):
                label = np.where(keep, confident(xs[1 - i].logits(sure[1 - i])), -1)
                z = np.clip(x.logits(now[i]), -30, 30)
                p = sigmoid(z)
                # the tightest quadratic above the loss at z, spread over the components
                bend = np.where(np.abs(z) < 1e-6, 0.25, (p - 0.5) / np.where(z == 0, 1.0, z)) * x.lengths()
                for c in (0, 1):
                    on = (label == c).astype(np.float64)
                    sums[i][c, 0] += on.sum()
                    sums[i][c, 1] += x.weighed(on * (p - c))
                    sums[i][c, 2] += x.weighed(on * bend)
        for i in (0, 1):
            c, kind, at = np.nonzero(sums[i])
            some = [pa.array(np.full(len(at), i, np.int32)), *(pa.array(v.astype(np.int32)) for v in (c, kind, at)), pa.array(sums[i][c, kind, at])]
            yield pa.RecordBatch.from_arrays(some, ["view", "label", "kind", "at", "x"])

    left = rows.join(F.broadcast(fitted.select("doc_id", F.lit(True).alias("fitted"))), "doc_id", "left")
    found = left.select("wb", "wc", "sh", "mb", "fitted").mapInArrow(run, "view int, label int, kind int, at int, x double")
    # sums of double precision: the same in any order but for rounding far below what a fit shows
    total = found.groupBy("view", "label", "kind", "at").agg(F.sum("x").alias("x")).toArrow()
    view, label, kind, at, x = (total[c].to_numpy() for c in ("view", "label", "kind", "at", "x"))
    out = []
    for i, n in enumerate(widths):
        sums, on = np.zeros((2, 3, n)), view == i
        sums[label[on], kind[on], at[on]] = x[on]
        out.append(sums)
    return out


def gather(rows: DataFrame, labelled: DataFrame) -> Labelled | None:
    """Features of the labelled rows (MAX_LABELLED ids at most), in order of a hash; of rows that repeat an id, the least one."""
    row = F.struct("wb", "wc", "sh", "mb")
    picked = rows.join(F.broadcast(labelled), "doc_id").groupBy("doc_id", "y").agg(F.min(row).alias("r")).select("doc_id", "y", "r.*").toArrow()
    if not picked.num_rows:
        return None
    order = np.argsort(np.array([zlib.crc32(str(i).encode()) for i in picked["doc_id"].to_pylist()]), kind="stable")
    column = lambda c: [b for b in picked[c].take(pa.array(order)).to_pylist()]
    text, meta = TextRows(column("wb"), column("wc"), column("sh")), MetaRows(np.frombuffer(b"".join(column("mb")), "<i4"))
    return Labelled.of(text.dense(), meta.dense(), np.array(column("y"), np.float64))


def train(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """rows: features() of the documents. labels: doc_id, quality (0/1)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = materialize(known, "known")
    few = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    there = rows.select("doc_id").join(few, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"))  # one y an id
    fitted = materialize(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    held = gather(rows, fitted)
    if held is None or len(set(held.y.tolist())) < 2:
        n, ones = (0, 0) if held is None else (len(held.y), held.y.sum())
        return constant((ones + 1) / (n + 2))
    w = [held.learn(i) for i in (0, 1)]
    for _ in range(rounds):
        sure = w
        for _ in range(PASSES):
            sums = pseudo_sums(rows, fitted, sure, w)
            w = [held.learn(i, w[i], sums[i]) for i in (0, 1)]
    return held.calibrated(w)


def score(rows: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """rows: features() -> doc_id, p_text, p_meta, score (both views), kept: score >= keep."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in views(batches, 1):
            a, b, both = model.scores(text.logits(model.text), meta.logits(model.meta))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= keep)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() of all documents by train() on the labels."""
    return score(rows := features(docs), train(rows, labels))
