"""Files of any size, line by line, over as many tasks as they have byte ranges.

Spark's text reader cuts a file into ranges. How many lines each range has is counted in a
first scan, a row a range; a second scan numbers its own lines from there. So a line's
number in its file needs neither the file in one place nor a shuffle of lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.schemas import SCANNED, SECRET_PATTERNS

#: Byte ranges, or lines asked for, that are broadcast at most (some 100 bytes each).
BROADCAST = 500_000


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def source_lines(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """file, line_number (from 1), line of the files to scan; hidden, generated and output folders are left out.

    Lines end at line feeds alone. A carriage return before one stays in the line.
    """
    name = F.col("_metadata.file_path")
    ok = name.rlike(f"({'|'.join(map(re.escape, extensions))})$") & ~name.rlike(r"/\.[^/]+/|/node_modules/|/__pycache__/|/venv/|output")
    return numbered(spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).where(ok))


def numbered(text: DataFrame) -> DataFrame:
    """file, line_number, line of what the text reader reads."""
    at = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    ranges = at.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "_start", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    found = at.join(small(starts), ["file", "_start"])
    return found.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_number"), "line")


def pattern_lines(lines: DataFrame) -> DataFrame:
    """file, line_number, secret_type, line: one finding per line and pattern."""
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in SECRET_PATTERNS.items()]), lambda k: k.isNotNull())
    return lines.select("file", "line_number", F.explode(hits).alias("secret_type"), "line")


def random_lines(lines: DataFrame, least: float = 0.7) -> DataFrame:
    """file, line_number, secret_type, token: the first line of each token of a file that scores as a secret."""
    tokens = lines.select("file", "line_number", F.explode(F.array_distinct(T.candidates(F.col("line")))).alias("token"))
    first = tokens.groupBy("file", "token").agg(F.min("line_number").alias("line_number")).withColumn("entropy", T.entropy(F.col("token")))
    scored = first.withColumn("score", T.secret_score(F.col("token"), F.col("entropy"))).where((F.col("score") > 0.5) & (F.col("score") >= least))
    return scored.select("file", "line_number", F.lit("High Entropy").alias("secret_type"), "token")


def scan_lines(lines: DataFrame) -> DataFrame:
    """The findings that ``secrets.file_scan`` has of whole texts, from lines: patterns where a file has any, else entropy."""
    p = pattern_lines(lines).select("file", "line_number", "secret_type", T.context(F.col("line"), F.lit(1), 120).alias("context"), F.lit("regex").alias("detection_method"))
    e = random_lines(lines).select("file", "line_number", "secret_type", F.col("token").alias("context"), F.lit("entropy").alias("detection_method"))
    return p.unionByName(e.join(p.select("file").distinct(), "file", "left_anti"))


def surrounding(findings: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """findings: file, line_number and any columns -> with ``lines``, the text of ``around`` lines to either side and its own.

    Only lines that a finding asks for are kept, wherever they were read; a file is never in one place.
    """
    asked = findings.select("file", "line_number").distinct()
    near = F.sequence(F.greatest(F.col("line_number") - around, F.lit(1)), F.col("line_number") + around)
    wanted = asked.select("file", F.col("line_number").alias("_of"), F.explode(near).alias("line_number"))
    found = lines.join(small(wanted), ["file", "line_number"])
    texts = found.groupBy("file", F.col("_of").alias("line_number")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda x: x.line), "\n").alias("lines"))
    return findings.join(texts, ["file", "line_number"], "left")
