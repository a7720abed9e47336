"""Finding and masking secrets: entropy scan, fixed patterns, plug-in scanners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.functions.schemas import FINDING, PII_HIGH, SECRET_PATTERNS
from chatloom.operators.topn import first_rows


def entropy_findings(rows: DataFrame, key: str, text: str, least: float = 0.7) -> DataFrame:
    """Distinct candidate tokens of a text that score above 0.5 and ``least``, with line and place."""
    scored = scored_candidates(rows, key, text)
    hits = scored.where((F.col("score") > 0.5) & (F.col("score") >= least))
    return hits.select(
        key, F.col("line_number"), F.lit("High Entropy").alias("secret_type"), F.lit("MEDIUM").alias("severity"), F.least("score", F.lit(1.0)).alias("confidence"),
        T.masked(F.col("token")).alias("masked_value"), F.col("token").alias("context"), F.lit("entropy").alias("detection_method"), F.lit(1).alias("scanner"), "pos",
    )


def scored_candidates(rows: DataFrame, key: str, text: str) -> DataFrame:
    tokens = rows.select(key, text, F.posexplode(F.array_distinct(T.candidates(F.col(text)))).alias("pos", "token"))
    e = T.entropy(F.col("token"))
    return tokens.withColumn("entropy", e).select(key, "pos", "token", "entropy", T.secret_score(F.col("token"), F.col("entropy")).alias("score"), T.line_of(F.col(text), F.col("token")).alias("line_number"))


def pattern_findings(rows: DataFrame, key: str, text: str, first_lines: int | None = None) -> DataFrame:
    """One finding per line and pattern."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    if first_lines:
        lines = lines.where(F.col("pos") < first_lines)
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in SECRET_PATTERNS.items()]), lambda k: k.isNotNull())
    return lines.select(key, (F.col("pos") + 1).alias("line_number"), F.explode(hits).alias("secret_type"), "line", "pos")


def scan(rows: DataFrame, key: str, text: str, plugins: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] | None = None) -> DataFrame:
    """Findings of all scanners in order, less repeats on a line.

    plugins: name -> function over pandas batches (key, text) giving FINDING columns and
    key, as ``mapInPandas`` takes; none by default, and none is ever downloaded.
    """
    found = entropy_findings(rows, key, text)
    kind = rows.schema[key].dataType.simpleString()
    for i, (name, plugin) in enumerate((plugins or {}).items()):
        cols = ", ".join(c for c in FINDING.split(", ") if not c.startswith("file_path"))
        more = rows.select(key, text).mapInPandas(plugin, f"{key} {kind}, {cols}")
        found = found.unionByName(more.withColumns({"scanner": F.lit(2 + i), "pos": F.lit(0)}), allowMissingColumns=True)
    return distinct_findings(found, [key])


def distinct_findings(findings: DataFrame, by: list[str]) -> DataFrame:
    """The first finding of each line and start of context."""
    w = Window.partitionBy(*by, "line_number", F.substr("context", F.lit(1), F.lit(50))).orderBy("scanner", "pos")
    return findings.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def file_scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Built-in cascade: pattern findings where a text has any, else entropy findings."""
    p = pattern_findings(rows, key, text).select(key, "line_number", "secret_type", T.context(F.col("line"), F.lit(1), 120).alias("context"), F.lit("regex").alias("detection_method"))
    e = entropy_findings(rows, key, text).select(key, "line_number", "secret_type", "context", "detection_method")
    return p.unionByName(e.join(p.select(key).distinct(), key, "left_anti"))


def severity(rule: Column) -> Column:
    return F.when(F.lower(rule).rlike("test|dev|sample|high entropy"), "MEDIUM").otherwise("HIGH")


def pii_findings(found: DataFrame, least: float = 0.7) -> DataFrame:
    """Entities of an external recogniser that score enough, with severity."""
    return found.where(F.col("score") >= least).withColumn("severity", F.when(F.col("entity").isin(*PII_HIGH), "HIGH").otherwise("MEDIUM"))


def not_test_data(raw: Column) -> Column:
    return ~F.lower(raw).rlike("example|test|fake|sample")


def mask_tokens(text: Column, least: float = 0.7) -> Column:
    """The text with every token that scores as a secret masked, natively and wherever it stands."""
    tokens = F.array_distinct(T.candidates(text))
    secret = F.filter(tokens, lambda t: (T.secret_score(t, T.entropy(t)) > 0.5) & (T.secret_score(t, T.entropy(t)) >= least))
    longest = F.array_sort(secret, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda acc, t: F.replace(acc, t, T.masked(t)))


def mask_patterns(text: Column) -> Column:
    for p in SECRET_PATTERNS.values():
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def gate(rows: DataFrame, key: str, text: str, first_lines: int = 1000) -> DataFrame:
    """One row: ``passed``, and the number of pattern findings in each text's first lines."""
    n = pattern_findings(rows, key, text, first_lines).agg(F.count(F.lit(1)).alias("findings"))
    return n.select((F.col("findings") == 0).alias("passed"), "findings")


def before_first(rows: DataFrame, flagged: Column, order: str) -> DataFrame:
    """Rows before the first flagged one: a run that stops at a secret. One number goes to the driver."""
    stop = rows.where(flagged).agg(F.min(order)).first()[0]
    return rows if stop is None else rows.where(F.col(order) < stop)


def line_context(lines: DataFrame, by: str, line: str = "line_number", text: str = "line", around: int = 2) -> DataFrame:
    w = Window.partitionBy(by).orderBy(line).rowsBetween(-around, around)
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def report(findings: DataFrame, order: list[str], medium: int = 5) -> DataFrame:
    """All findings of high severity and the first few of medium, by ``order``, each with its severity's count, n.

    The first few are kept in bounded memory by each task, so a severity may have any
    number of findings.
    """
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    shown = findings.where("severity = 'HIGH'").unionByName(first_rows(findings.where("severity = 'MEDIUM'"), "severity", order, medium))
    return shown.join(F.broadcast(counts), "severity")  # as many rows as there are severities
