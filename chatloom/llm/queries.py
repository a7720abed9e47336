"""Queries of the training-data operators, opN_<name>, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import ball_tree, chat_format, cotraining, filter_audit, licenses, line_dedup, mixing, pieces, quality_rules
from chatloom.llm import sharding, simhash, spelling, token_counts
from chatloom.llm.common import materialize, table


#: Vocabulary files; any path that all executors can open.
TOKENIZERS = os.environ.get("CHATLOOM_TOKENIZERS", "/opt/tokenizers")
PIECES, RANKS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(quality_rules.features(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source"), "measured")
    judged = quality_rules.judge(measured, quality_rules.host_rates(measured))
    long = [F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *long, F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), *[F.round(f"_q_rate_{r}", 6).alias(f"rate_{r}") for r in quality_rules.RULES])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" "))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), same.alias("round_trip"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), RANKS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", "source", mixing.row_hash(F.col("doc_id"), F.col("text")).alias("h"), mixing.count_words(F.col("text")).alias("size")), "mix-docs")
    plan = mixing.mix_plan(rows)
    taken = mixing.join_plan(rows, plan)
    return taken.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_times")).alias("taken"), F.col("_times").cast("long").alias("times"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row reaches its message as events that the fold has to put in order, undo and join."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    kind = {f.name: f.dataType for f in log.schema}
    said = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), said.alias("role"), F.lit(probe).alias("text"))
    events = chat_format.as_events(log.unionByName(extra))
    return chat_format.digest(chat_format.render(chat_format.fold(events)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.runs(F.col("text"), 7)).alias("run"))
    return spelling.group_variants(spelling.dictionary(docs.select(spelling.misspelt(F.col("doc_id"), F.col("run")).alias("word"))))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_quality_classifier,
        op3_exact_top_k,
        op4_line_dedup,
        op5_sentencepiece,
        op6_simhash,
        op7_token_counts,
        op8_license_scan,
        op9_mixing,
        op10_chat_format,
        op11_spelling_variants,
        op12_sharding,
        op13_filter_audit,
    )
}

_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS k FROM win),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
cover AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS c FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM again) GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, 10 * n_symbols > n_words AS symbols,
  10 * n_dup_lines > 3 * n_lines AS dup_lines, (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS word_length FROM m),
h AS (SELECT source, rule, count(*) AS docs, sum(failed::INT) AS fails FROM (SELECT source,
  unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS rule, unnest([base_failed, symbols, dup_lines, word_length]) AS failed FROM f) GROUP BY source, rule),
p AS (SELECT rule, sum(fails) / sum(docs) AS mean, sum(docs * (fails / docs) * (fails / docs)) / sum(docs) AS m2, count(*) / sum(docs) AS chance FROM h GROUP BY rule),
q AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(m2 - mean * mean - mean * (1 - mean) * chance, 1e-12) - 1, 1.0), 1000.0) AS weight FROM p),
r AS (SELECT source, rule, (fails + mean * weight) / (docs + weight) AS rate FROM h JOIN q USING (rule)),
v AS (SELECT source AS host, max(rate) FILTER (WHERE rule = 'base') AS rate_base, max(rate) FILTER (WHERE rule = 'symbols') AS rate_symbols,
  max(rate) FILTER (WHERE rule = 'dup_lines') AS rate_dup_lines, max(rate) FILTER (WHERE rule = 'word_length') AS rate_word_length FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (symbols AND greatest(rate_symbols, rate_base) > 0.5) AND NOT (dup_lines AND greatest(rate_dup_lines, rate_base) > 0.5)
    AND NOT (word_length AND greatest(rate_word_length, rate_base) > 0.5) AS kept,
  round(rate_base, 6) AS rate_base, round(rate_symbols, 6) AS rate_symbols, round(rate_dup_lines, 6) AS rate_dup_lines, round(rate_word_length, 6) AS rate_word_length
FROM f JOIN v ON source IS NOT DISTINCT FROM host"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT source AS src, count(*) AS pages FROM d GROUP BY source),
c AS (SELECT source AS host, key AS boiler, count(DISTINCT r) AS held FROM k WHERE key <> '' GROUP BY source, key),
b AS (SELECT host, boiler FROM c JOIN n ON host IS NOT DISTINCT FROM src WHERE held >= 5 AND held > 0.1::DOUBLE * pages),
m AS (SELECT k.*, boiler IS NOT NULL AS gone FROM k LEFT JOIN b ON host IS NOT DISTINCT FROM source AND boiler = key),
t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS cleaned FROM m GROUP BY r)
SELECT doc_id, cleaned AS text, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped FROM d JOIN t USING (r)"""

_OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM s),
a AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM w
  WINDOW b AS (ORDER BY cap / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) * w >= cap * (all_w - w_before) AS capped FROM a),
e AS (SELECT *, total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS rest, sum(w) FILTER (WHERE NOT capped) OVER () AS rest_w FROM c),
t AS (SELECT source AS src, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (rest * w)::DOUBLE / rest_w::DOUBLE END AS target FROM e),
x AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
y AS (SELECT *, target - whole * source_size AS budget FROM x),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(size) OVER (PARTITION BY source, h) AS own FROM d JOIN y ON source IS NOT DISTINCT FROM src),
z AS (SELECT *, upto < budget OR (upto - own < budget AND upto - budget < budget - (upto - own)) AS below FROM r)
SELECT doc_id, size, source_size, target, size * least(whole + below::INT, 3) AS taken, least(whole + below::INT, 3)::BIGINT AS times FROM z"""

_OP10 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) + 24 AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_OP11 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, times, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT),
  lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295::BIGINT)) AS h FROM c, crc),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM k),
e AS (SELECT x.word AS u, y.word AS v, y.n AS m FROM g x JOIN g y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.less = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.less = w.word),
b AS (SELECT u, count(*) AS near, first(v ORDER BY m DESC, v) AS best, max(m) AS best_n FROM e GROUP BY u),
f AS (SELECT word, n, coalesce(near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM w LEFT JOIN b ON word = u),
p AS (SELECT word, word AS at, form AS further FROM f UNION ALL SELECT p.word, f.word, f.form FROM p JOIN f ON p.further = f.word)
SELECT f.word, form, p.at AS root, n, n_near, form_n FROM f JOIN p ON f.word = p.word AND p.further IS NULL"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
e AS (SELECT t AS same, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(first < doc_id, false) AS e, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic
  FROM w JOIN e ON t = same LEFT JOIN l ON doc_id = id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
z AS (SELECT g.*, filter_order, list_transform(string_split(filter_order, ''), lambda k: CASE k WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM g, o),
y AS (SELECT *, unnest(range(1, 6)) AS step FROM z),
k AS (SELECT part, filter_order, step::INT AS step,
  sum(n) FILTER (WHERE NOT list_bool_or(fails[1:step])) AS kept,
  sum(n) FILTER (WHERE fails[step] AND NOT coalesce(list_bool_or(fails[1:step - 1]), false)) AS removed,
  sum(n) FILTER (WHERE fails[step] AND list_bool_or(fails[1:step - 1])) AS redundant,
  sum(n) FILTER (WHERE fails[step] AND len(list_filter(fails, lambda v: v)) = 1) AS unique_fails,
  sum(good) FILTER (WHERE fails[step] AND NOT coalesce(list_bool_or(fails[1:step - 1]), false)) AS good_lost,
  sum(toxic) FILTER (WHERE fails[step] AND NOT coalesce(list_bool_or(fails[1:step - 1]), false)) AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM k"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _OP1,
    "op3_exact_top_k": _OP3,
    "op4_line_dedup": _OP4,
    "op9_mixing": _OP9,
    "op10_chat_format": _OP10,
    "op11_spelling_variants": _OP11,
    "op13_filter_audit": _OP13,
}
