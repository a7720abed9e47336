"""Host-level quality rules, in DataFrame operations only.

Each document is held against rules; the failures of each rule are summed by host; each
host's rates are shrunk towards the corpus by a beta prior fitted to the hosts, one for
each rule; and the verdicts on the host are joined back to its documents. The base rule
rejects a document on any host. Another rule rejects one only on hosts whose shrunk rate
of failures of that rule, or of the base rule, is above ``max_host_rate``. A document
without any failure always stays.

Cases: a null or blank text has no words and fails the base rule. A null host is a host
of its own. Repeated rows are judged one by one. Empty tables give no rows. Columns of
the input are kept, whatever their names (``features`` alone replaces those it adds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import BLANKS, materialize, pack, unpack, words_of
from chatloom.operators.skew import salted_join

SYMBOLS = "#*$%&|<>"
#: Words of a window that is looked for again in its own text.
WINDOW = 5
#: Host tables of so many rows at most are broadcast, larger ones joined by a salted shuffle.
BROADCAST_HOSTS = 100_000
MAX_HOST_RATE = 0.5
#: The rules' names, see rules().
RULES = ("base", "symbols", "dup_lines", "word_length")
#: Bounds of the prior's weight in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0


def window_hashes(words: str) -> Column:
    """XXH64 of each window of WINDOW words, in order; two different windows of a text agree with a chance of 2^-64."""
    n = F.size(words)
    return F.when(
        n > WINDOW,
        F.transform(
            F.slice(words, 1, n - (WINDOW - 1)),
            lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, WINDOW)]),
        ),
    )


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """Add _q_host and the measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (as _q_<name>)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"_q_w": words_of(F.col("text")), "_q_host": F.col(host)})
    with_word = F.filter(F.split(text, "\n"), lambda s: F.rtrim(s, F.lit(BLANKS)) != "")
    d = d.withColumns(
        {
            "_q_hashes": window_hashes("_q_w"),
            "_q_lines": with_word,
            "_q_n_words": F.size("_q_w").cast("long"),
            "_q_word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "_q_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    ).drop("_q_w")
    d = d.withColumn("_q_twice", F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"))
    # null where nothing repeats: the rest of the work is left out
    d = d.withColumn(
        "_q_sorted",
        F.when(F.col("_q_twice"), F.array_sort(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))
    d = d.withColumn(
        "_q_again",
        F.array_sort(
            F.transform(
                F.filter(
                    "_q_sorted",
                    lambda x, j: same(F.get("_q_sorted", j - 1), x) | same(F.get("_q_sorted", j + 1), x),
                ),
                lambda x: x.i,
            )
        ),
    )
    gap = F.transform("_q_again", lambda i, j: F.least(F.coalesce(F.get("_q_again", j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    return d.withColumns(
        {
            "_q_n_repeat_words": F.coalesce(F.aggregate(gap, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        }
    ).drop("_q_hashes", "_q_lines", "_q_twice", "_q_sorted", "_q_again")


def rules() -> dict[str, Column]:
    """The rules over the measures: true where a document fails. ``base`` rejects on any host."""
    q = lambda c: F.col(f"_q_{c}")
    return {
        "base": (q("n_words") < 10) | (100 * q("n_repeat_words") > 20 * q("n_words")),
        "symbols": 10 * q("n_symbols") > q("n_words"),
        "dup_lines": 10 * q("n_dup_lines") > 3 * q("n_lines"),
        "word_length": (q("word_chars") < 2 * q("n_words")) | (q("word_chars") > 12 * q("n_words")),
    }


def failures(which: str | None = None) -> dict[str, Column]:
    """The rules over the measures, or over flags that have been taken from them before (in columns ``which``<rule>)."""
    return rules() if which is None else {r: F.col(f"{which}{r}") for r in RULES}


def host_rates(measured: DataFrame, max_host_rate: float = MAX_HOST_RATE, flags: str | None = None) -> DataFrame:
    """One row per host: docs, and by rule rate_<rule> (of documents that fail it, shrunk) and bad_<rule> (above max_host_rate).

    Each rule has a beta prior of its own, by moments: its mean m is the corpus rate, its
    weight m (1 - m) / v - 1, within PRIOR_LEAST and PRIOR_MOST. v is the variance of host
    rates weighted by documents, less what chance alone adds to it, m (1 - m) hosts / docs.
    """
    sums = [F.sum(c.cast("int")).alias(f"n_{r}") for r, c in failures(flags).items()]
    hosts = materialize(measured.groupBy("_q_host").agg(F.count(F.lit(1)).alias("docs"), *sums), "hosts")
    rate = lambda r: F.col(f"n_{r}") / F.col("docs")
    moments = [(F.sum(f"n_{r}") / F.sum("docs")).alias(f"m_{r}") for r in RULES]
    moments += [(F.sum(F.col("docs") * rate(r) * rate(r)) / F.sum("docs")).alias(f"s_{r}") for r in RULES]
    total = hosts.agg(*moments, (F.count(F.lit(1)) / F.sum("docs")).alias("chance"))
    spread = lambda r: F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
    v = lambda r: F.greatest(F.col(f"s_{r}") - F.col(f"m_{r}") * F.col(f"m_{r}") - spread(r) * F.col("chance"), F.lit(1e-12))
    weights = [F.least(F.greatest(spread(r) / v(r) - 1, F.lit(PRIOR_LEAST)), F.lit(PRIOR_MOST)).alias(f"w_{r}") for r in RULES]
    prior = total.select(*[f"m_{r}" for r in RULES], *weights).first()  # two numbers a rule
    out = hosts
    for r in RULES:
        m, w = prior[f"m_{r}"] or 0.0, prior[f"w_{r}"] or PRIOR_LEAST
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + m * w) / (F.col("docs") + w))
    return out.select("_q_host", "docs", *[f"rate_{r}" for r in RULES], *[(F.col(f"rate_{r}") > max_host_rate).alias(f"bad_{r}") for r in RULES])


def with_verdicts(measured: DataFrame, hosts: DataFrame, row_id: str) -> DataFrame:
    """The hosts' rates and verdicts, as _q_rate_<rule> and _q_bad_<rule>, joined back to the documents."""
    key = "_q_key"  # a null host joins too
    name = F.coalesce(F.concat(F.lit("h"), F.col("_q_host").cast("string")), F.lit("null"))
    measured = measured.withColumn(key, name)
    verdicts = hosts.select(name.alias(key), *[F.col(f"{x}_{r}").alias(f"_q_{x}_{r}") for x in ("rate", "bad") for r in RULES])
    if hosts.count() <= BROADCAST_HOSTS:
        return measured.join(F.broadcast(verdicts), key, "left").drop(key)
    return salted_join(measured, verdicts, key, F.col(row_id)).drop(key)


def kept(fails: dict[str, Column]) -> Column:
    """Whether a document stays: base rejects on any host; another failure rejects where the host is bad by that rule or by base."""
    soft = [fails[r] & (F.col(f"_q_bad_{r}") | F.col("_q_bad_base")) for r in RULES if r != "base"]
    return ~fails["base"] & ~F.greatest(*soft)


def judge(measured: DataFrame, hosts: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Join the hosts' verdicts back: adds their columns, _q_base_failed and _q_kept."""
    fails = rules()
    return with_verdicts(measured, hosts, row_id).withColumns({"_q_base_failed": fails["base"], "_q_kept": kept(fails)})


def filter_documents(docs: DataFrame, host: str = "source", row_id: str = "doc_id") -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts aren't shuffled.

    The measures are taken once, into a table of flags and of the rows that pass the base
    rule; the hosts are judged from the flags, and the table filtered by the verdicts.
    """
    flags = {f"_f_{r}": c for r, c in rules().items()}
    measured = features(pack(docs, text="text", host=host, id=row_id), "host").withColumns(flags)
    row = F.when(~F.col("_f_base"), F.col("_row")).alias("_row")
    rows = materialize(measured.select(row, "id", "_q_host", *flags), "judged", "zstd")
    judged = with_verdicts(rows.where(~F.col("_f_base")), host_rates(rows, flags="_f_"), "id")
    return unpack(judged.where(kept(failures("_f_"))))
