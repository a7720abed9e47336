"""Site-relative line deduplication.

Pages are grouped by host; the number of pages that hold a line is divided by the
host's page total; lines above the boilerplate ratio are dropped from the host's pages.

A line is compared by the XXH64 of its text without outer blanks; it counts once per
page. Blank lines are never boilerplate. A page whose lines all go keeps its row, with
an empty text.

Cases: a null text stays null and counts as a page. A null host is a host of its own.
Hosts below MIN_PAGES pages for a line drop nothing. Repeated rows are pages of their
own. Empty tables give no rows. Columns of the
input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import BLANKS, materialize, pack, unpack
from chatloom.operators.skew import salted_join

#: A line in more than RATIO of a host's pages, and in MIN_PAGES pages at least, is boilerplate.
RATIO, MIN_PAGES = 0.1, 5
#: Boilerplate of so many lines in all is broadcast; more is joined by a salted shuffle.
BROADCAST_LINES = 200_000


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("null"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _lines (hashes of its boilerplate lines). A host has at most its mean of lines a page / ratio of them."""
    pages = docs.select(host_key(host).alias("_host"), F.col("text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("pages"))
    filled = F.filter(F.split("text", "\n"), lambda s: F.trim(s, F.lit(BLANKS)) != "")
    lines = pages.select("_host", F.explode(F.array_distinct(F.transform(filled, line_hash))).alias("line"))
    often = lines.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = materialize(often, "lines")
    found = often.join(totals, "_host").where(F.col("n") > ratio * F.col("pages"))
    return materialize(found.groupBy("_host").agg(F.array_sort(F.collect_list("line")).alias("_lines")), "boilerplate")


def drop_boilerplate(docs: DataFrame, host: str = "source", row_id: str = "doc_id", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with boilerplate lines dropped from ``text``, and _n_lines and _n_dropped."""
    lines = boilerplate(docs, host, ratio, min_pages)
    size = lines.agg(F.sum(F.size("_lines"))).first()[0] or 0
    keyed = pack(docs, text="text", host=host, id=row_id).withColumn("_host", host_key("host"))
    joined = keyed.join(F.broadcast(lines), "_host", "left") if size <= BROADCAST_LINES else salted_join(keyed, lines, "_host", F.col("id"))
    split = F.split("text", "\n")
    kept = F.filter("_split", lambda s: (F.trim(s, F.lit(BLANKS)) == "") | ~F.array_contains("_lines", line_hash(s)))
    out = joined.withColumn("_split", split).withColumn("_kept", F.when(F.col("_lines").isNull(), F.col("_split")).otherwise(kept))
    n = F.coalesce(F.size("_split"), F.lit(0)).cast("long")
    n = F.greatest(n, F.lit(0))
    dropped = F.coalesce(F.size("_split") - F.size("_kept"), F.lit(0)).cast("long")
    text = F.when(dropped == 0, F.col("text")).otherwise(F.array_join("_kept", "\n"))
    return unpack(out, text=text, _n_lines=n, _n_dropped=dropped)
