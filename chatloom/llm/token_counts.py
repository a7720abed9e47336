"""Token counts of flat, unindexed token files by a separator scan.

A token file holds unsigned integers one after another, an end-of-document identifier
after each document, and nothing else: no offsets, no counts. Files are read by byte
ranges, so a file of many documents spreads over tasks; but what lies between two separators
is one row of the reader, so one document is held whole, and so is a file without any. A task cuts its
range into blocks and searches every block for the identifier at once, and gives each
document that lies within its block. What a block leaves open at its ends (a head before
the first separator, a tail after the last) is stitched across blocks by a prefix scan over
block summaries in two levels: ranges within a file, blocks within a range.

A range doesn't know its place in the file until the scan has added up what is before it,
nor, therefore, which bytes begin a token. So a block is searched at every alignment, and
the scan tells which one holds; the others hardly ever find anything.

``write_tokens`` makes such files from texts. A document may begin with a prologue of
PROLOGUE identifiers that carry its integer id in base 2^15 (none is a separator), so
that counts lead back to documents without an index.

Cases: a null or empty text is a document of no tokens; a null id is carried as such. What
follows the last separator of a file is a document if it isn't empty (``closed`` is false).
Files without tokens give no rows; a file that ends within a token is an error. Repeated
rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import delete, fresh_path, materialize

EOD = 50256
DTYPE = "<u2"
#: Identifiers before a document that hold its id: 5 times 15 bits hold any long, and a bit that says that it is null.
PROLOGUE, NULL_ID = 5, 1 << 64
#: Tokens of a written row, about, and rows of a file: no more than ROW_TOKENS and the longest document at once.
ROW_TOKENS, FILE_ROWS = 1 << 19, 128
BLOCK_BYTES = 1 << 21
# Fixed value: the pattern that cuts texts before the vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def prologue(ident: int | None, n: int = PROLOGUE) -> list[int]:
    bits = NULL_ID if ident is None else ident & NULL_ID - 1
    return [bits >> 15 * i & 0x7FFF for i in range(n)]


def idents(digits: np.ndarray) -> pa.Array:
    """Ids of rows of prologue digits."""
    out = np.zeros(len(digits), np.uint64)
    for i in range(digits.shape[1]):
        out |= digits[:, i].astype(np.uint64) << np.uint64(15 * i)
    none = digits[:, -1] >> 4 & 1 == 1 if digits.shape[1] == PROLOGUE else np.zeros(len(digits), bool)
    return pa.array(out.view(np.int64), mask=none)


def ident_of(raw: Column, item: int) -> Column:
    """The same of one prologue's bytes."""
    digits = []
    for i in range(PROLOGUE):
        hexes = [F.hex(F.substring(raw, i * item + k + 1, 1)) for k in reversed(range(item))]
        digits.append(F.conv(F.concat(*hexes), 16, 10).cast("long"))
    bits = digits[0]
    for i, d in enumerate(digits[1:], 1):
        bits = bits.bitwiseOR(F.shiftleft(d, 15 * i))
    whole = (F.octet_length(raw) >= PROLOGUE * item) & (digits[-1].bitwiseAND(F.lit(16)) == 0)
    return F.when(whole, bits)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str | None = "doc_id", eod: int = EOD) -> None:
    """Write the texts' tokens as flat files under ``path`` with Spark's own writer, so on any file system.

    vocabulary: a file of BPE ranks that all executors can open. The text writer puts
    bytes out as they are, several documents a row, and the separator is its end of line.
    """
    mark = np.array([eod], DTYPE).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([mark.join(held)], pa.binary())], ["tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode_ordinary(text or "")
                    held.append(np.array((prologue(i) if key else []) + ids, DTYPE).tobytes())
                    size += len(ids)
                    if size >= ROW_TOKENS:
                        yield row()
                        held, size = [], 0
        if held:
            yield row()

    ids = F.col(key).cast("long") if key else F.lit(0).cast("long")
    flat = docs.select(ids.alias("i"), "text").mapInArrow(run, "tokens binary")
    flat = flat.select(F.col("tokens").cast("string").alias("value"))
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).option("maxRecordsPerFile", FILE_ROWS).text(path)


def find(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Byte offsets where a mark stands in raw, at any alignment, overlaps included."""
    n = len(raw) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    on = raw[:n] == mark[0]
    for k in range(1, len(mark)):
        on &= raw[k : n + k] == mark[k]
    return np.flatnonzero(on)


def scan_block(raw: np.ndarray, mark: bytes, prologue_size: int) -> Iterator[tuple]:
    """Rows of one block at each alignment, (part, align, starts, sizes, ids, leads) in bytes from the block's begin.

    ``doc``: the documents between its separators; ``head``: what comes before the first;
    ``tail``: after the last; ``whole``: all of a block that has none. leads: the bytes
    where a prologue may be, as many as the block has of them.
    """
    item, lead = len(mark), prologue_size * len(mark)
    hits = find(raw, mark)
    nobody = lambda n: pa.nulls(n, pa.int64())
    for align in range(item):
        ends = hits[hits % item == align]
        if not len(ends):
            yield "whole", align, np.array([0]), np.array([len(raw)]), nobody(1), [raw[:lead].tobytes()]
            continue
        yield "head", align, np.array([0]), ends[:1], nobody(1), [raw[: min(lead, ends[0])].tobytes()]
        starts, sizes = ends[:-1] + item, np.diff(ends) - item
        if len(starts):
            who = nobody(len(starts))
            if prologue_size:
                at = np.minimum(starts[:, None] + np.arange(lead), len(raw) - 1)
                digits = raw[at].reshape(-1).view(f"<u{item}").reshape(-1, prologue_size)
                who = idents(digits)
            yield "doc", align, starts, sizes, who, [b""] * len(starts)
        last = int(ends[-1]) + item
        yield "tail", align, np.array([last]), np.array([len(raw) - last]), nobody(1), [raw[last : last + lead].tobytes()]


ROWS = "file string, length long, range long, block int, part string, align int, start long, n long, ident long, lead binary"


def carrier(mark: bytes) -> bytes:
    """What the range reader splits its bytes by: the separator itself, or, where it could overlap itself, a byte that isn't in it."""
    overlaps = any(mark[k:] == mark[: len(mark) - k] for k in range(1, len(mark)))
    return bytes([next(b for b in (10, *range(1, 128)) if b not in mark)]) if overlaps else mark


def scan(spark: SparkSession, path: str, eod: int, dtype: str, prologue_size: int, block_bytes: int) -> DataFrame:
    """Rows of all blocks of all files, and a row ``block`` for each block with its number of bytes."""
    mark = np.array([eod], dtype).tobytes()
    by = carrier(mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size, block = None, [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            raw = np.frombuffer(by.join(held) + by, np.uint8)
            whole = "block", 0, np.array([0]), np.array([len(raw)]), pa.nulls(1, pa.int64()), [b""]
            for part, align, starts, sizes, who, leads in (whole, *scan_block(raw, mark, prologue_size)):
                m = len(starts)
                same = [pa.array([here[0]] * m), *[pa.array(np.full(m, x)) for x in (here[1], here[2])], pa.array(np.full(m, block, np.int32)), pa.array([part] * m), pa.array(np.full(m, align, np.int32))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts.astype(np.int64)), pa.array(sizes.astype(np.int64)), who, pa.array(leads, pa.binary())], ROWS.replace(",", "").split(" ")[::2])

        for batch in batches:
            names, lengths, ranges = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                now = names[i], lengths[i], ranges[i]
                if now != here or size >= block_bytes:
                    if held:
                        yield from rows()
                    here, held, size, block = now, [], 0, block + 1 if now == here else 0
                    if now[1] % len(mark):
                        raise ValueError(f"{now[0]}: {now[1]} bytes aren't whole tokens")
                held.append(batch.column(3)[i].as_py())
                size += len(held[-1]) + len(by)
        if held:
            yield from rows()

    # the text reader gives the bytes between its separators as they are, in order within a range
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", by.decode("latin-1")).text(path)
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_block_start")]
    return raw.select(*meta, F.col("value").cast("binary")).mapInArrow(run, ROWS)


def before(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows with ``before``: the sum of ``value`` over all rows that come earlier in their file, by range and then ``order``.

    Two windows: over a file's ranges, one row each, and over the rows of a range.
    """
    ranges = rows.groupBy("file", "range").agg(F.sum(value).alias("_all"))
    w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_all").over(w), F.lit(0))).drop("_all")
    w = Window.partitionBy("file", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(w), F.lit(0))
    return rows.withColumn("_within", within).join(ranges, ["file", "range"]).withColumn("before", F.col("_base") + F.col("_within")).drop("_base", "_within")


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, dtype: str = DTYPE, prologue_size: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, start (in tokens), n_tokens (without the prologue), ident (from the prologue, else null), closed."""
    if prologue_size not in (0, PROLOGUE):
        raise ValueError(f"prologues have {PROLOGUE} identifiers")
    item = np.dtype(dtype).itemsize
    rows = materialize(scan(spark, path, eod, dtype, prologue_size, block_bytes), "token-blocks")
    blocks = before(rows.where("part = 'block'").select("file", "range", "block", "n"), "n", "block")
    at = blocks.select("file", "range", "block", F.col("before").alias("at"))
    placed = rows.where("part <> 'block'").join(at, ["file", "range", "block"]).where(F.col("align") == F.pmod(-F.col("at"), F.lit(item)))
    placed = placed.withColumn("start", F.col("at") + F.col("start")).where(F.col("start") <= F.col("length"))
    # the reader's separator after the file's last bytes is none of the file's own
    past = F.col("part").isin("doc", "head") & (F.col("start") + F.col("n") >= F.col("length"))
    part = F.when(past & (F.col("part") == "doc"), "tail").when(past, "whole").otherwise(F.col("part"))
    placed = placed.withColumns({"part": part, "n": F.least(F.col("n"), F.col("length") - F.col("start"))})
    columns = ["file", "start", "n", "ident", "closed"]
    within = placed.where("part = 'doc'").withColumn("closed", F.lit(True)).select(*columns)
    # stitching: a document begins at a tail or at the file's start and ends at the next head
    edges = placed.where("part <> 'doc'").withColumns({"opens": (F.col("part") == "tail").cast("int"), "turn": (F.col("part") == "tail").cast("int")})
    edges = before(edges, "opens", "block", "turn").withColumn("run", F.col("before") + F.col("opens"))
    lead = F.array_sort(F.collect_list(F.struct("start", "turn", "lead")))
    opened = edges.groupBy("file", "run").agg(
        F.min("start").alias("start"),
        F.sum("n").alias("n"),
        F.min("ident").alias("ident"),
        F.aggregate(lead, F.lit(b""), lambda got, x: F.when(F.octet_length(got) < PROLOGUE * item, F.concat(got, x.lead)).otherwise(got)).alias("lead"),
        F.max(F.col("part") == "head").alias("closed"),
    )
    opened = opened.where("closed or n > 0").withColumn("ident", F.coalesce("ident", ident_of(F.col("lead"), item)))
    found = within.unionByName(opened.select(*columns))
    ident = F.col("ident") if prologue_size else F.lit(None).cast("long")
    return found.select("file", (F.col("start") / item).cast("long").alias("start"), ((F.col("n") / item).cast("long") - prologue_size).alias("n_tokens"), ident.alias("ident"), "closed")


def count_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and n_tokens of every document, by way of flat token files in the shared folder, removed once they are scanned."""
    spark = docs.sparkSession
    write_tokens(docs, path := fresh_path(spark, "tokens"), vocabulary)
    counts = count_tokens(spark, path, prologue_size=PROLOGUE).select(F.col("ident").alias("doc_id"), "n_tokens")
    delete(spark, path)
    return counts
