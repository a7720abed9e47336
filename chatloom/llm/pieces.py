"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece of the vocabulary reaches across, and each distinct cut is
encoded once: the cuts of a batch are concatenated, a suffix array of the text is
built (sorted by as many characters as the longest piece has, which is all a piece can
tell apart), every piece is found by binary search as a range of it, the occurrences
are edges, sorted by the position where they end, and the edges are relaxed in that order.

The models here are BPE models, whose result isn't the best sum of scores. What is
relaxed is validity: the encoding of a prefix that ends with a piece is the encoding of
the prefix before it and that piece, if the two last pieces stand beside one another
in an encoding of their own (no merge across their border comes first). Just one edge
into each position passes, so the relaxed path is the result of the merges, identifier by
identifier.

A cut begins with its blanks. Pieces of blanks alone share one score, below all others, so
in a run of them only the last blank may join what follows, and the rest merge from the
left after everything else: the word is encoded with one blank, as any cut is, and the run
is a repetition of the longest such piece and a remainder (checked when a model is loaded;
a model of another kind has its runs merged one by one). A cut of more than LONG_CUT
characters, as in scripts without blanks, is indexed in blocks and relaxed by itself.

Cases: a null or empty text has no identifiers. Characters without a piece become byte
pieces. As in the format itself, a U+2581 in a text reads back as a blank. Repeated
rows are encoded one by one; an empty table gives no rows. Columns of the input are kept, but for those
that the result's names replace.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The format's mark for a blank. Inside, pieces and cuts hold blanks as such.
MARK, BLANK = "\u2581", " "
#: Characters that are indexed at once, and bytes of distinct cuts that a worker remembers, about (others are encoded again).
INDEX_CHARS, REMEMBERED = 100_000, 64 << 20
#: What a remembered cut takes besides its text and identifiers.
ENTRY = 200
LONG_CUT = 256
#: Slots of the table of pairs whose validity is known.
SLOTS = 1 << 20
NEVER = 1 << 40


class Vocabulary:
    """Pieces of a model with their merges."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.vocab_size()
        names = [sp.id_to_piece(i).replace(MARK, BLANK) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.kind = np.dtype("<u2") if n < 1 << 16 else np.dtype("<u4")
        self.bytes = {int(names[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text = [b"" if special[i] else bytes([int(names[i][3:-1], 16)]) if sp.is_byte(i) else names[i].encode() for i in range(n)]
        self.score = {names[i]: sp.get_score(i) for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.id = {names[i]: i for i in range(n) if names[i] in self.score}
        # merges in order: single characters come before all, then pieces by score
        self.order = np.full(n + 2, -1, np.int64)
        longer = sorted((p for p in self.id if len(p) > 1), key=lambda p: (-self.score[p], self.id[p]))
        for i, p in enumerate(longer):
            self.order[self.id[p]] = i
        self.parts = np.zeros((n + 2, 2), np.int64)
        usable = [p for p in self.id if len(p) == 1]
        for p in longer:
            whole, last = self.merge(p)
            if len(whole) == 1 and p.strip(BLANK):
                usable.append(p)
                self.parts[self.id[p]] = [self.id[x] for x in last]
        joins = {}
        for p in longer:
            for i in range(1, len(p)):
                if p[:i] in self.id and p[i:] in self.id:
                    joins[self.id[p[:i]] * (n + 2) + self.id[p[i:]]] = self.order[self.id[p]]
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_order = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        self.longest = max(map(len, usable))
        alphabet = sorted({c for p in usable for c in p})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.pieces = np.array([self.id[p] for p in usable])
        self.length = np.ones(n + 2, np.int64)
        self.length[self.pieces] = [len(p) for p in usable]
        self.codes = np.zeros((len(usable), self.longest), np.uint16)
        for i, p in enumerate(usable):
            self.codes[i, : len(p)] = self.code[[ord(c) for c in p]]
        self.slot_key = np.full(SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(SLOTS, bool)
        # where a cut is safe: before a mark that follows no character but these in a piece
        after: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:], strict=False):
                after.setdefault(b, set()).add(a)
        self.marks = [(m, sorted(after.get(m, ()))) for m in ",.;:\n\r\t!?" if len(after.get(m, ())) < 60]
        self.free = [m for m in "\n\r\t" if m not in after and not any(m in p for p in self.id)]
        self.blank_safe = after.get(BLANK, set()) <= {BLANK}
        self.blank_runs = self.check_runs()

    def check_runs(self) -> bool:
        """Whether runs of blanks are encoded as described above."""
        blank = [p for p in self.id if p and not p.strip(BLANK)]
        if BLANK not in self.id or any(BLANK * 2 in p for p in self.id if p.strip(BLANK)):
            return False
        others = (self.score[p] for p in self.id if len(p) > 1 and p.strip(BLANK))
        if max((self.score[p] for p in blank if len(p) > 1), default=-np.inf) >= min(others, default=np.inf):
            return False
        self.widest = max(map(len, blank))
        self.run_ids = [[self.id[s] for s in self.merge(BLANK * k)[0]] for k in range(self.widest)]
        wide = self.id[BLANK * self.widest]
        return all([self.id[s] for s in self.merge(BLANK * k)[0]] == [wide] * (k // self.widest) + self.run_ids[k % self.widest] for k in range(4 * self.widest))

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges themselves: the best score first, the leftmost of equals. Symbols of ``text``, and the last merge."""
        symbols: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and (both := symbols[i] + symbols[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        last = None
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != both:
                continue
            last = (symbols[i], symbols[j])
            symbols[i], symbols[j] = both, None
            right[i] = right[j]
            if right[i] < len(symbols):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s is not None], last

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a merge joins symbols a and b, or NEVER."""
        key = a * (self.size + 2) + b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_order[at], NEVER)

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when a text of just these two is encoded.

        Their inner merges are undone, the later first; a merge across the border that
        comes before the one undone would have been made instead.
        """
        key = a * (self.size + 2) + b
        slot = (key * 0x9E3779B1 >> 11) & SLOTS - 1
        known = self.slot_key[slot] == key
        out = self.slot_ok[slot]
        if known.all():
            return out
        fresh, back = np.unique(key[~known], return_inverse=True)
        x, y = np.divmod(fresh, self.size + 2)
        ok = np.ones(len(fresh), bool)
        before = np.full(len(fresh), NEVER)
        live = np.arange(len(fresh))
        while len(live):
            u, v = x[live], y[live]
            clash = self.joined(u, v) < before[live]
            ok[live[clash]] = False
            ou, ov = self.order[u], self.order[v]
            going = ~clash & ((ou >= 0) | (ov >= 0))
            live, u, v, ou, ov = (z[going] for z in (live, u, v, ou, ov))
            first = ou > ov
            before[live] = np.where(first, ou, ov + 1)
            x[live] = np.where(first, self.parts[u, 1], u)
            y[live] = np.where(first, v, self.parts[v, 0])
        out = out.copy()
        out[~known] = ok[back]
        s = (fresh * 0x9E3779B1 >> 11) & SLOTS - 1
        self.slot_key[s] = fresh
        won = self.slot_key[s] == fresh  # of two keys for one slot, the answer of the one that stands there
        self.slot_ok[s[won]] = ok[won]
        return out

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of pieces in coded text (0: in no piece): piece and start."""
        n = self.longest
        present = np.unique(text)
        narrow = np.zeros(int(self.code.max()) + 1, np.uint16)
        narrow[present[present > 0]] = np.arange(1, np.count_nonzero(present) + 1)
        kind, top = (np.dtype("u1"), 0xFF) if np.count_nonzero(present) < 0xFF else (np.dtype(">u2"), 0xFFFF)
        padded = np.concatenate([narrow[text], np.zeros(n, np.uint16)]).astype(kind)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, n)[: len(text)])
        width = f"S{n * kind.itemsize}"
        keys = windows.view(width).ravel()
        suffixes = np.argsort(keys)
        keys = keys[suffixes]
        codes = narrow[self.codes]
        sought = ((codes > 0) | (self.codes == 0)).all(axis=1)
        low = codes[sought]
        ids = self.pieces[sought]
        high = np.where(np.arange(n)[None, :] < self.length[ids][:, None], low, top)
        a = np.searchsorted(keys, np.ascontiguousarray(low.astype(kind)).view(width).ravel(), "left")
        b = np.searchsorted(keys, np.ascontiguousarray(high.astype(kind)).view(width).ravel(), "right")
        count = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return np.repeat(ids, count), suffixes[at]

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """Identifiers of each cut, in the bytes of ``kind``."""
        joined = "\0".join(cuts) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        ends = starts + sizes
        text = self.code[np.minimum(chars, 0x10FFFF)]
        cut_of = np.repeat(np.arange(len(cuts)), sizes + 1)
        offset = np.arange(len(chars)) - starts[cut_of]
        text[ends] = 0
        piece, start = self.edges(text)
        none, first = self.size, self.size + 1  # a character without a piece; the start of a cut
        lone = np.flatnonzero((text == 0) & (offset < sizes[cut_of]))
        piece, start = np.r_[piece, np.full(len(lone), none)], np.r_[start, lone]
        stop = offset[start] + self.length[piece]
        by = np.argsort(stop, kind="stable")
        piece, start, stop = piece[by], start[by], stop[by]
        last = np.full(len(chars) + 1, -1, np.int64)
        last[starts] = first
        for group_piece, group_start in zip(*(np.split(x, np.flatnonzero(np.diff(stop)) + 1) for x in (piece, start)), strict=True):
            before = last[group_start]
            ok = before == first
            ask = np.flatnonzero(~ok & (before >= 0))
            ok[ask] = self.beside(before[ask], group_piece[ask])
            last[group_start[ok] + self.length[group_piece[ok]]] = group_piece[ok]
        # back along the path of each cut
        who, at, found_who, found = np.flatnonzero(sizes > 0), ends[sizes > 0], [], []
        while len(who):
            token = last[at]
            found_who.append(who)
            found.append(np.where(token == none, -1 - chars[at - 1].astype(np.int64), token))
            at = at - self.length[token]
            going = at > starts[who]
            who, at = who[going], at[going]
        if not found:
            return [b""] * len(cuts)
        who, token = np.concatenate(found_who)[::-1], np.concatenate(found)[::-1]
        by = np.argsort(who, kind="stable")
        who, token = who[by], token[by]
        bounds = np.searchsorted(who, np.arange(len(cuts) + 1))
        if (token < 0).any():
            parts = [np.array([z for y in token[i:j].tolist() for z in ([y] if y >= 0 else self.fallback(chr(-1 - y)))], self.kind).tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
            return parts
        raw, w = token.astype(self.kind).tobytes(), self.kind.itemsize
        return [raw[i * w : j * w] for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]

    def encode_long(self, cut: str) -> bytes:
        """The same for one long cut, relaxed position by position; blocks bound what is indexed at once."""
        chars = np.frombuffer(cut.encode("utf-32-le", "surrogatepass"), "<u4")
        text = self.code[np.minimum(chars, 0x10FFFF)]
        none, first, k = self.size, self.size + 1, self.size + 2
        last = [-1] * (len(chars) + 1)
        last[0] = first
        before_piece, before_stop = np.array([first]), np.array([0])  # edges that end in this block or later
        length = self.length.tolist()
        for at in range(0, len(chars), INDEX_CHARS):
            piece, start = self.edges(text[at : at + INDEX_CHARS + self.longest])
            own = start < INDEX_CHARS
            piece, start = piece[own], start[own] + at
            lone = np.flatnonzero(text[at : at + INDEX_CHARS] == 0) + at
            piece, start = np.r_[piece, np.full(len(lone), none)], np.r_[start, lone]
            by = np.argsort(start, kind="stable")
            piece, start = piece[by], start[by]
            stop = start + self.length[piece]
            # every pair of an edge and one that ends where it starts
            all_piece, all_stop = np.r_[before_piece, piece], np.r_[before_stop, stop]
            by = np.argsort(all_stop, kind="stable")
            ends = all_stop[by]
            a, b = np.searchsorted(ends, start, "left"), np.searchsorted(ends, start, "right")
            n = b - a
            left = all_piece[by[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]]
            keys = np.unique(left * k + np.repeat(piece, n))
            x, y = np.divmod(keys, k)
            fine = x == first
            fine[~fine] = self.beside(x[~fine], y[~fine])
            valid = set(keys[fine].tolist())
            for p, s, e in zip(piece.tolist(), start.tolist(), stop.tolist(), strict=True):
                if last[s] >= 0 and last[s] * k + p in valid:
                    last[e] = p
            later = all_stop >= at + INDEX_CHARS
            before_piece, before_stop = all_piece[later], all_stop[later]
        out, e = [], len(chars)
        while e:
            p = last[e]
            out += [p] if p != none else self.fallback(chr(chars[e - 1]))[::-1]
            e -= length[p]
        return np.array(out[::-1], self.kind).tobytes()

    def fallback(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def direct(self, cut: str) -> bytes:
        out = []
        for s in self.merge(cut)[0]:
            out += [self.id[s]] if s in self.id else self.fallback(s)
        return np.array(out, self.kind).tobytes()

    def with_run(self, cut: str, known: dict[str, bytes]) -> bytes:
        """A cut that begins with several blanks, from the encoding of its word with one blank."""
        word = known[BLANK + cut.lstrip(BLANK)]
        n, lone = len(cut) - len(cut.lstrip(BLANK)) - 1, np.array([self.id[BLANK]], self.kind).tobytes()
        if word.startswith(lone):
            n, word = n + 1, word[len(lone) :]
        ids = [self.id[BLANK * self.widest]] * (n // self.widest) + self.run_ids[n % self.widest]
        return np.array(ids, self.kind).tobytes() + word

    def cuts(self, text: str) -> list[str]:
        """Cuts of a text, a blank before it: between a character and a blank after it, and before and after marks where
        no piece holds both sides."""
        t = BLANK + text.replace(MARK, BLANK)
        sep = next(c for c in map(chr, (*range(9), *range(0xFDD0, 0xFDF0), 0xFFFE)) if c not in t)
        if not self.blank_safe:
            return [t]
        t = t.replace(BLANK, sep + BLANK)
        run = BLANK + sep + BLANK
        while run in t:
            t = t.replace(run, BLANK * 2)
        for mark, _ in self.marks:
            if mark in t:
                t = t.replace(mark, sep + mark + sep if mark in self.free else sep + mark)
        for mark, befores in self.marks:
            if mark in t:
                for b in befores:
                    while (held := b + sep + mark) in t:  # again for marks in a row
                        t = t.replace(held, b + mark)
        return [c for c in t.split(sep) if c]

    def encoder(self):
        """A function from texts to their identifiers' bytes, which remembers cuts."""
        known: dict[str, bytes] = {}
        weight = 0

        def add(fresh: set[str]) -> None:
            nonlocal weight
            runs = {c for c in fresh if BLANK * 2 in c}
            todo = sorted((fresh - runs | {BLANK + c.lstrip(BLANK) for c in runs if self.blank_runs}).difference(known))
            short = [c for c in todo if len(c) <= LONG_CUT]
            known.update(zip(short, self.encode_cuts(short), strict=True)) if short else None
            known.update((c, self.encode_long(c)) for c in todo if len(c) > LONG_CUT)
            known.update((c, self.with_run(c, known) if self.blank_runs else self.direct(c)) for c in runs)
            weight += sum(len(c) + len(known[c]) + ENTRY for c in (*todo, *runs))

        def encode(texts: list[str | None]) -> list[bytes]:
            nonlocal known, weight
            out = []
            cut = [self.cuts(t) if t else [] for t in texts]
            at = 0
            while at < len(cut):  # as many texts as stay within what is remembered, one at least
                if weight > REMEMBERED:
                    known, weight = {}, 0
                fresh: set[str] = set()
                size, begin = 0, at
                while at < len(cut) and (at == begin or weight + size * 2 + len(fresh) * ENTRY <= REMEMBERED):
                    new = set(cut[at]).difference(known, fresh)
                    fresh |= new
                    size += sum(map(len, new)) + len(new)
                    at += 1
                    if size > INDEX_CHARS:
                        add(fresh)
                        fresh, size = set(), 0
                if fresh:
                    add(fresh)
                out += [b"".join(map(known.__getitem__, cs)) for cs in cut[begin:at]]
            return out

        return encode

    def decode(self, ids: np.ndarray) -> str:
        """The text of identifiers, without the blank that encoding puts before it."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(2)
def encoder(path: str):
    return vocabulary(path).encoder()


STEP = 512


def with_columns(df: DataFrame, makers: list[tuple[str, str, str, Callable]]) -> DataFrame:
    """df and columns (source, name, kind, make), each made from another by make()(values), values being None for null.

    All are made in one pass, so a task needs one Python worker however many there are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.drop(*(m[1] for m in makers))
    schema = df.select("*", *[F.lit(None).cast(kind).alias(name) for _, name, kind, _ in makers]).schema
    arrow = to_arrow_schema(schema)
    names = [*df.columns, *(m[1] for m in makers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [make() for *_, make in makers]
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                columns = [c.cast(t) for c, t in zip(batch.slice(i, STEP).columns, arrow.types, strict=False)]
                for (source, *_), apply in zip(makers, ready, strict=True):
                    columns.append(pa.array(apply(columns[names.index(source)]), arrow.types[len(columns)]))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def encoding(model: str, text: str = "text", name: str = "ids") -> tuple[str, str, str, Callable]:
    def make():
        to_bytes, kind = encoder(model), vocabulary(model).kind
        return lambda column: [np.frombuffer(b, kind).astype(np.int32) for b in to_bytes(column.to_pylist())]

    return text, name, "array<int>", make


def decoding(model: str, ids: str = "ids", name: str = "decoded") -> tuple[str, str, str, Callable]:
    def make():
        back = vocabulary(model).decode
        return lambda column: [back(x.values.to_numpy()) if x.is_valid else None for x in column]

    return ids, name, "string", make


def encode(docs: DataFrame, model: str, name: str = "ids", text: str = "text") -> DataFrame:
    """Add array<int> ``name``. model: a SentencePiece BPE model file that all executors can open."""
    return with_columns(docs, [encoding(model, text, name)])


def decode(rows: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add string ``name``; null identifiers decode to null."""
    return with_columns(rows, [decoding(model, ids, name)])


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """Add ids and what they decode to."""
    return with_columns(docs, [encoding(model), decoding(model)])
