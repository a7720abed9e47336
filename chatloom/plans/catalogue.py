"""Queries over the tables of conversations, documents, embeddings and events, one or more for each operator, and the
same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import content as C
from chatloom.functions import text as T
from chatloom.functions import vectors as A
from chatloom.functions.schemas import CODE_REQUESTS, ERROR_INDICATORS, FILLERS, MASTER_SYSTEM, MESSAGES, NOT_SECRET, SECRET_PATTERNS
from chatloom.operators import conversations as V
from chatloom.operators import dedup, masks, metrics, sampling, secrets
from chatloom.plans import pipelines
from chatloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gather(table(spark, sf_dir, "conversations"))


def csv(c: Column) -> Column:
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


def quoted(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.lower().replace("'", "''") + "'" for x in items) + "]"


NL = "chr(10)"
#: Conversations in SQL: arrays of structs in the order of turns.
TALKS = "c AS (SELECT conv_id, list({role: role, content: text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

# masks and formats


@query(f"""
WITH {TALKS} SELECT conv_id, len(m)::INT AS n_messages, len(list_filter(m, lambda x: x.role = 'assistant'))::INT AS n_train, len(list_filter(m,
 lambda x: x.role <> 'assistant'))::INT AS n_ignore, array_to_string(list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'assistant'),
 ',') AS train_indices FROM c""")
def conv_loss_mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = talks(spark, sf_dir).withColumn("k", masks.loss_mask("messages"))
    return k.select("conv_id", F.size("messages").alias("n_messages"), F.size("k.train_indices").alias("n_train"), F.size("k.ignore_indices").alias("n_ignore"), csv(F.col("k.train_indices")).alias("train_indices"))


@query(f"""WITH {TALKS}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m ELSE list_prepend({{role: 'system', content: '{MASTER_SYSTEM}'}}, m) END AS m FROM c)
SELECT conv_id, len(m)::INT AS n_messages, len(list_filter(m, lambda x: x.role = 'assistant'))::INT AS n_train, array_to_string(list_filter(range(0, len(m)), lambda i: m[i + 1].role = 'assistant'), ',') AS train_indices,
 len(list_filter(m, lambda x: x.role = 'assistant' AND length(x.content) >= 500)) > 0 AS long_enough FROM s""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a system prompt in front, their loss masks, and whether an answer is long enough."""
    rows = talks(spark, sf_dir).withColumn("messages", V.with_system("messages", F.lit(True))).withColumn("k", masks.loss_mask("messages"))
    return rows.select("conv_id", F.size("messages").alias("n_messages"), F.size("k.train_indices").alias("n_train"), csv(F.col("k.train_indices")).alias("train_indices"), V.long_enough("messages", 500).alias("long_enough"))


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS idx, role, (role = 'assistant')::INT AS mask,
 length(text)::INT AS n_chars FROM conversations""")
def conv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talks(spark, sf_dir).withColumn("s", F.explode(masks.loss_mask("messages").segments))
    return rows.select("conv_id", F.col("s.index").alias("idx"), "s.role", "s.mask", F.length(F.get("messages", F.col("s.index")).content).alias("n_chars"))


@query(f"""
WITH {TALKS} SELECT conv_id, (m[1].role = 'system') AS had_system, CASE WHEN m[1].role = 'system' AND len(list_filter(['helpful assistant',
 'you are an ai', 'you are a helpful', 'opencode', 'assistant designed to'], lambda g: contains(lower(m[1].content), g))) = 0 THEN m[1].content
 ELSE '{MASTER_SYSTEM}' END AS first_content, (len(m) + (m[1].role <> 'system')::INT)::INT AS n_messages FROM c""")
def conv_system_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talks(spark, sf_dir)
    had = F.get("messages", F.lit(0)).role == "system"
    rows = rows.select("conv_id", had.alias("had_system"), V.with_system("messages", F.lit(False)).alias("m"))
    return rows.select("conv_id", "had_system", F.get("m", F.lit(0)).content.alias("first_content"), F.size("m").alias("n_messages"))


@query("""
SELECT conv_id, sha256(string_agg('<' || role || '>' || text || '</' || role || '>', chr(10) ORDER BY turn, role,
 text) FILTER (WHERE text <> '')) AS h FROM conversations GROUP BY conv_id""")
def conv_tagged_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", F.sha2(V.tagged_text("messages"), 256).alias("h"))


@query(f"""
SELECT conv_id, coalesce(string_agg(role || ': ' || text, {NL} ORDER BY turn, role, text) FILTER (WHERE role IN ('system', 'user', 'tool')
 AND text <> ''), '') AS input_text, coalesce(string_agg('assistant: ' || text, {NL} ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'
 AND text <> ''), '') AS output_text FROM conversations GROUP BY conv_id""")
def conv_training_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", V.training_input("messages").alias("input_text"), V.training_output("messages").alias("output_text"))


@query("""
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS pos, CASE WHEN role = 'assistant' THEN 'gpt'
 ELSE 'human' END AS from_, text AS value FROM conversations WHERE role IN ('system', 'user', 'assistant', 'tool') AND text <> ''""")
def conv_sharegpt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talks(spark, sf_dir).select("conv_id", F.posexplode(V.to_sharegpt("messages")).alias("pos", "t"))
    return rows.select("conv_id", "pos", F.col("t").getField("from").alias("from_"), F.col("t").getField("value").alias("value"))


@query("""
WITH k AS (SELECT conv_id, string_agg(text, chr(10) || '--' || chr(10) ORDER BY turn, role, text) FILTER (WHERE role IN ('user', 'system',
 'tool')) AS human, string_agg(text, chr(10) || '--' || chr(10) ORDER BY turn, role, text) FILTER (WHERE role = 'assistant') AS gpt FROM conversations
 WHERE text <> '' GROUP BY conv_id) SELECT conv_id, coalesce(human, '') AS user_text, coalesce(gpt, '') AS assistant_text FROM k""")
def conv_sharegpt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = talks(spark, sf_dir).select("conv_id", V.from_sharegpt(V.to_sharegpt("messages")).alias("m"))
    part = lambda role: F.array_join(F.transform(F.filter("m", lambda x: x.role == role), lambda x: x.content), "\n--\n")
    return back.select("conv_id", part("user").alias("user_text"), part("assistant").alias("assistant_text"))


@query(rf"""WITH {TALKS}, p AS (SELECT conv_id, {TRIM.format("list_filter(m, lambda x: x.role = 'system')[1].content")} AS s, {TRIM.format("list_filter(m, lambda x: x.role = 'user')[1].content")} AS u,
 list_filter(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: {TRIM.format("x.content")}), lambda t: t <> '') AS a FROM c),
q AS (SELECT *, a[len(a)] AS last FROM p)
SELECT conv_id, CASE WHEN coalesce(s, '') = '' THEN 'missing_system' WHEN coalesce(u, '') = '' THEN 'missing_user' WHEN coalesce(last, '') = '' THEN 'missing_assistant' WHEN len({WORDS.format("last")}) < 100 THEN 'too_short' ELSE 'valid' END AS reason, md5(coalesce(last, '')) AS answer FROM q""")
def conv_clean_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.clean_triple(talks(spark, sf_dir), 100)
    return rows.select("conv_id", "reason", F.md5(F.coalesce("assistant_text", F.lit(""))).alias("answer"))


@query(rf"""WITH {TALKS}, d AS (SELECT CASE WHEN len(list_filter(m, lambda x: x.role = 'user')) = 0 THEN 'missing_user' WHEN len(list_filter(m, lambda x: x.role = 'assistant')) = 0 THEN 'missing_assistant'
 WHEN len(list_filter(m, lambda x: x.role = 'assistant' AND length(x.content) >= 500)) = 0 THEN 'too_short'
 WHEN len({WORDS.format("list_filter(m, lambda x: x.role = 'assistant' AND x.content <> '')[1].content")}) < 120 THEN 'few_words' ELSE 'kept' END AS reason FROM c)
SELECT reason, count(*) AS n FROM d GROUP BY reason""")
def conv_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda role: F.exists("messages", lambda m: m.role == role)
    tests = [("missing_user", ~has("user")), ("missing_assistant", ~has("assistant")), ("too_short", ~V.long_enough("messages", 500)), ("few_words", ~V.enough_words("messages", 120))]
    rows = talks(spark, sf_dir).select(F.coalesce(V.first_reason(tests), F.lit("kept")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT conv_id, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS ones, coalesce(sum(length(text)), 0)::BIGINT AS n
 FROM conversations GROUP BY conv_id""")
def conv_char_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talks(spark, sf_dir).select("conv_id", masks.char_mask("messages").alias("k"))
    return rows.select("conv_id", F.aggregate("k", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"), F.size("k").cast("long").alias("n"))


@query(rf"""
WITH {TALKS}, f AS (SELECT conv_id, list_filter(m, lambda x: x.role = 'assistant' AND x.content <> '')[1].content AS a FROM c) SELECT conv_id,
 (a IS NULL OR len({WORDS.format('a')}) >= 100) AS kept FROM f""")
def conv_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", V.enough_words("messages", 100).alias("kept"))


@query("SELECT role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'end') AS next_role, conv_id, turn FROM conversations")
def conv_next_role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("role", F.coalesce(F.lead("role").over(w), F.lit("end")).alias("next_role"), "conv_id", "turn")


@query(f"""
WITH {TALKS}, p AS (SELECT conv_id, lower(coalesce(list_filter(m, lambda x: x.role = 'user')[1].content, '')) AS u, coalesce(list_filter(m,
 lambda x: x.role = 'assistant')[1].content, '') AS a FROM c), q AS (SELECT conv_id, len(list_filter({quoted(CODE_REQUESTS)}, lambda k: contains(u,
 k))) > 0 AS asks, contains(a, '```') AS fence FROM p) SELECT conv_id, asks, (NOT asks OR fence) AS ok FROM q""")
def conv_code_request_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", V.asks_for_code("messages").alias("asks"), V.code_answered("messages").alias("ok"))


@query(f"""
WITH {TALKS}, p AS (SELECT conv_id, lower(array_to_string(list_transform(list_filter(m, lambda x: x.role IN ('user', 'assistant', 'system')),
 lambda x: x.content), ' ')) AS t FROM c) SELECT conv_id, len(list_filter({quoted(ERROR_INDICATORS)}, lambda e: contains(t, e))) = 0 AS ok,
 TRUE AS tools_ok FROM p""")
def conv_error_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", V.no_error_content("messages").alias("ok"), V.tools_intact("messages").alias("tools_ok"))


@query(f"""
WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Sure! ' WHEN turn % 3 = 1 THEN 'here''s the ' ELSE '' END || text AS t
 FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN ltrim(t[6:], ' ' || chr(10))
 WHEN turn % 3 = 1 THEN ltrim(t[7:], ' ' || chr(10)) WHEN len(list_filter({quoted(FILLERS)}, lambda f: starts_with(lower(t), f))) > 0 THEN 'filler'
 ELSE t END) AS h FROM x""")
def conv_filler_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers put before the table's answers, and taken off."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    start = F.when(F.col("turn") % 3 == 0, "Sure! ").when(F.col("turn") % 3 == 1, "here's the ").otherwise("")
    message = F.array(F.struct("role", F.concat(start, "text").alias("content"), F.lit(None).alias("tool_calls"))).cast(MESSAGES)
    rows = rows.withColumn("m", V.without_fillers(message, V.fillers(F.lit(None).cast("string"))))
    return rows.select("conv_id", "turn", F.md5(F.get("m", F.lit(0)).content).alias("h"))


# deduplication and sampling

DOUBLED = "u AS (SELECT conv_id AS ord, * FROM conversations UNION ALL SELECT conv_id + 1000000 AS ord, * FROM conversations WHERE conv_id % 3 = 0)"


@query(f"WITH {DOUBLED}, f AS (SELECT ord, first(text ORDER BY turn, text) FILTER (WHERE role = 'user') AS t FROM u GROUP BY ord), h AS (SELECT ord, sha256(lower({TRIM.format("coalesce(t, '')")})) AS h FROM f) SELECT min(ord) AS ord, h, count(*) AS copies FROM h GROUP BY h")
def user_query_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    both = c.withColumn("ord", F.col("conv_id")).unionByName(c.where("conv_id % 3 = 0").withColumn("ord", F.col("conv_id") + 1000000))
    rows = V.gather(both, conv="ord").withColumn("h", dedup.user_hash("messages"))
    kept = dedup.keep_first(rows, F.col("h"), "ord").select("ord", "h")
    return kept.join(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")), "h").select("ord", "h", "copies")


@query("SELECT doc_id, sha256(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.keep_first(docs, F.col("h"), "doc_id")


@query("SELECT count(*) AS total, (count(*) - count(DISTINCT text))::BIGINT AS duplicates, count(DISTINCT text) AS unique FROM documents")
def doc_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_stats(table(spark, sf_dir, "documents"), F.sha2("text", 256))


@query("SELECT conv_id, sha256(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id")
def conv_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).select("conv_id", dedup.sample_hash("messages").alias("h"))


@query("SELECT doc_id, sha256(text || source) AS h FROM documents")
def doc_pair_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", dedup.pair_hash(F.col("text"), F.col("source")).alias("h"))


@query("""
SELECT doc_id, 0 AS batch FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1
 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.resume(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")).select("doc_id", "batch")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text))")
def benchmark_contains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage."""
    items = table(spark, sf_dir, "benchmark").select(F.col("text").alias("passage"))
    return dedup.holding(table(spark, sf_dir, "documents"), items).select("doc_id")


RATIOS = {"src0": 0.5, "src1": 0.29, "src2": 0.21}


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) SELECT doc_id,
 source FROM r WHERE rn <= CASE source WHEN 'src0' THEN 50 WHEN 'src1' THEN 28 WHEN 'src2' THEN 21 END""")
def source_quota_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_sample(table(spark, sf_dir, "documents"), RATIOS, 100).select("doc_id", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def shuffle_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled_limit(table(spark, sf_dir, "documents").select("doc_id"), 100)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE
 WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'val' END AS part FROM r""")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"))


@query("""
SELECT doc_id, ord, ((ord - 1) // 64)::INT AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM documents
 WHERE n_chars >= 100)""")
def shard_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.global_rank(table(spark, sf_dir, "documents").where("n_chars >= 100").select("doc_id"), [F.col("doc_id")])
    return sampling.shards(rows, 64).select("doc_id", "ord", "shard")


@query("SELECT doc_id, ord FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM documents WHERE n_chars >= 100) WHERE ord > 50 AND ord <= 100")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.global_rank(table(spark, sf_dir, "documents").where("n_chars >= 100").select("doc_id"), [F.col("doc_id")])
    return sampling.page(rows, 50, 50).select("doc_id", "ord")


@query(f"""
SELECT doc_id FROM documents WHERE len({WORDS.format("text")}) >= 150 AND NOT regexp_matches(text, '[#$%&*|]') ORDER BY doc_id LIMIT 50""")
def refill_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents, by id, of 150 words or more and without symbols; those beyond aren't tried."""
    keep = (F.size(T.words(F.col("text"))) >= 150) & ~F.col("text").rlike("[#$%&*|]")
    return sampling.refill(table(spark, sf_dir, "documents"), keep, 50, "doc_id").select("doc_id")


# secrets

CANDIDATES = r"k AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}'))) AS token FROM documents)"
ENTROPY = "(SELECT -sum(n / length(token) * ln(n / length(token)) / ln(2)) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(token, '')) AS ch) GROUP BY ch))"
SCORE = rf"""CASE WHEN regexp_full_match(token, '[A-Za-z]+|[0-9]+') THEN 0.0::DOUBLE ELSE
 (CASE WHEN e > 5.5 THEN 0.4::DOUBLE WHEN e > 4.5 THEN 0.25::DOUBLE ELSE 0::DOUBLE END)
 + (CASE WHEN kinds >= 3 THEN 0.3::DOUBLE WHEN kinds >= 2 THEN 0.15::DOUBLE ELSE 0::DOUBLE END)
 + (CASE WHEN length(token) > 40 THEN 0.2::DOUBLE WHEN length(token) > 30 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
 + (CASE WHEN regexp_full_match(token, '[A-Za-z0-9_\-]+') THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
 - (CASE WHEN len(list_filter({quoted(NOT_SECRET)}, lambda w: contains(lower(token), w))) > 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END)
 - (CASE WHEN regexp_full_match(lower(token), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN 0.3::DOUBLE ELSE 0::DOUBLE END) END"""


@query(f"""
WITH {CANDIDATES}, s AS (SELECT doc_id, token, {ENTROPY} AS e, (regexp_matches(token, '[A-Z]')::INT + regexp_matches(token,
 '[a-z]')::INT + regexp_matches(token, '[0-9]')::INT + regexp_matches(token, '[^A-Za-z0-9]')::INT) AS kinds FROM k) SELECT doc_id, token, round(e,
 6) AS entropy, round({SCORE}, 6) AS score FROM s""")
def secret_candidates_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scored_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "token", F.round("entropy", 6).alias("entropy"), F.round("score", 6).alias("score"))


@query(f"WITH {CANDIDATES} SELECT doc_id, token, len(string_split(text[1:instr(text, token) - 1], chr(10)))::INT AS line_number FROM k")
def secret_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scored_candidates(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "token", "line_number")


FOUND = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents), f AS (" + " UNION ALL ".join(f"SELECT doc_id, line_number::INT AS line_number, '{k}' AS secret_type FROM l WHERE regexp_matches(line, '{p}')" for k, p in SECRET_PATTERNS.items()) + ")"


@query(f"WITH {FOUND} SELECT * FROM f")
def secret_regex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.pattern_findings(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line_number", "secret_type")


@query(f"WITH {FOUND} SELECT secret_type, 'HIGH' AS severity, count(*) AS n FROM f GROUP BY secret_type")
def secret_findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.pattern_findings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("secret_type", secrets.severity(F.col("secret_type")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


MASKED_SQL = "text"
for _p in SECRET_PATTERNS.values():
    MASKED_SQL = f"regexp_replace({MASKED_SQL}, '{_p}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({MASKED_SQL}) AS h, (length({MASKED_SQL}) <> length(text)) AS changed FROM documents")
def secret_masked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", secrets.mask_patterns(F.col("text")).alias("m"))
    return rows.select("doc_id", F.sha2("m", 256).alias("h"), (F.length("m") != F.length("text")).alias("changed"))


@query(f"""
WITH {CANDIDATES} SELECT doc_id, token[1:4] || repeat('*', length(token) - 8) || token[-4:] AS masked, round(len(list_distinct(string_split(token,
 ''))) / length(token), 6) AS ratio FROM k""")
def unique_char_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scored_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", T.masked(F.col("token")).alias("masked"), F.round(T.distinct_ratio(F.col("token")), 6).alias("ratio"))


@query(f"WITH {FOUND}, r AS (SELECT doc_id, line_number, min(secret_type) AS secret_type FROM f GROUP BY doc_id, line_number) SELECT * FROM r")
def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.pattern_findings(table(spark, sf_dir, "documents"), "doc_id", "text")
    names = F.dense_rank().over(Window.orderBy("secret_type"))
    kinds = found.select("secret_type").distinct().withColumn("scanner", names)  # a row per pattern
    found = found.join(F.broadcast(kinds), "secret_type").withColumn("context", F.col("line"))
    return secrets.distinct_findings(found, ["doc_id"]).select("doc_id", "line_number", "secret_type")


@query(f"WITH {FOUND} SELECT count(*) = 0 AS passed, count(*) AS findings FROM f WHERE line_number <= 1000")
def security_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.gate(table(spark, sf_dir, "documents"), "doc_id", "text")


# vectors


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


V2 = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"""
WITH {V2} SELECT vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs((v[i] + list_reverse(v)[i] + 2 * v[i]) / 3))), 5) AS total
 FROM e""")
def vec_fuse_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    fused = A.fuse([v, F.reverse(v), F.transform(v, lambda x: 2 * x)], "mean")
    return vectors(spark, sf_dir).select("vec_id", F.round(A.add(F.transform(fused, F.abs)), 5).alias("total"))


@query(f"WITH {V2} SELECT vec_id, (3 * len(v))::INT AS n, round(list_sum(v), 5) AS s FROM e")
def vec_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return vectors(spark, sf_dir).select("vec_id", v, A.fuse([v, F.reverse(v), v], "concat").alias("f")).select("vec_id", F.size("f").alias("n"), F.round(A.add(F.slice("f", 1, F.size("v"))), 5).alias("s"))


@query(f"""
WITH {V2}, w AS (SELECT *, lead(v, 2) OVER (PARTITION BY label ORDER BY vec_id) AS t, lead(vec_id % 3, 2) OVER (PARTITION BY label
 ORDER BY vec_id) AS k FROM e), x AS (SELECT label, (k > 0)::INT AS mask, list_sum(list_transform(range(1, len(v) + 1),
 lambda i: (v[i] - t[i]) * (v[i] - t[i]))) AS err, len(v) AS n FROM w WHERE t IS NOT NULL) SELECT label,
 round(coalesce(sum(mask * err) / nullif(sum(mask) * 64, 0), 0), 5) AS mse FROM x GROUP BY label""")
def vec_masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    pairs = A.shifted(rows, 1, "label", "vec_id", "v", "mask")
    return A.masked_mse(pairs, ["label"], "v", "target", "target_mask", 64).select("label", F.round("mse", 5).alias("mse"))


@query(f"""
WITH {V2}, x AS (SELECT vec_id, unnest(v) AS z, generate_subscripts(v, 1) - 1 AS token, list_max(v) AS top FROM e), p AS (SELECT vec_id, token,
 exp((z - top) / 0.1) / sum(exp((z - top) / 0.1)) OVER (PARTITION BY vec_id) AS prob FROM x), r AS (SELECT *, sum(prob) OVER (PARTITION BY vec_id
 ORDER BY prob DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) SELECT vec_id, count(*) AS kept, round(sum(prob), 5) AS mass
 FROM r WHERE b IS NULL OR b <= 0.9 GROUP BY vec_id""")
def vec_softmax_topp(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = vectors(spark, sf_dir).select("vec_id", F.posexplode(A.softmax(F.col("v"), 0.1)).alias("token", "prob"))
    return metrics.nucleus(probs, ["vec_id"]).groupBy("vec_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("prob"), 5).alias("mass"))


@query(f"WITH {V2} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS best FROM e")
def vec_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", A.argmax(F.col("v")).alias("best"))


@query(f"""
WITH {V2}, n AS (SELECT vec_id, least(10 + vec_id % 60, 48)::INT AS n, v FROM e) SELECT vec_id, n, (CASE WHEN n > 20 THEN 20
 ELSE n END)::INT AS filled FROM n""")
def vec_pad_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.slice("v", F.lit(1), (10 + F.col("vec_id") % 60).cast("int")).alias("h"))
    ids = A.fit_length(F.sequence(F.lit(1), F.lit(20)), F.col("h"), 48)
    return rows.select("vec_id", ids.alias("ids")).select("vec_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x > 0)).alias("filled"))


@query(f"""
WITH {V2}, d AS (SELECT e.vec_id, e.label, e.v, t.v AS w FROM e JOIN e t ON t.vec_id = e.vec_id + 1), m AS (SELECT vec_id, label, v, w,
 list_max(v) AS mv, list_max(w) AS mw FROM d), z AS (SELECT *, list_sum(list_transform(v, lambda x: exp((x - mv) / 2))) AS zv,
 list_sum(list_transform(w, lambda x: exp((x - mw) / 2))) AS zw FROM m) SELECT label, round(avg(4 * list_sum(list_transform(range(1, len(v) + 1),
 lambda i: exp((w[i] - mw) / 2) / zw * (((w[i] - mw) / 2 - ln(zw)) - ((v[i] - mv) / 2 - ln(zv)))))), 5) AS kl FROM z GROUP BY label""")
def vec_kl_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t")), "vec_id")
    return pairs.groupBy("label").agg(F.round(F.avg(A.kl_distillation(F.col("v"), F.col("t"))), 5).alias("kl"))


@query("""
SELECT n_nationkey AS n, r.range AS pos, r.range + 1 AS visible FROM nation, range(0, 25) r WHERE r.range < n_nationkey AND n_nationkey BETWEEN 1
 AND 24""")
def causal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").where("n_nationkey between 1 and 24").select(F.col("n_nationkey").alias("n"))
    rows = rows.select("n", F.posexplode(A.causal_mask(F.col("n"))).alias("pos", "r"))
    return rows.select("n", F.col("pos").cast("long").alias("pos"), F.size(F.filter("r", lambda x: x)).cast("long").alias("visible"))


@query("""
SELECT n_nationkey AS n, array_to_string([n_nationkey // 4, n_nationkey // 2, (3 * n_nationkey) // 4], ',') AS early, array_to_string([0,
 n_nationkey // 2, n_nationkey - 1], ',') AS ends FROM nation""")
def layer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("n"), csv(A.layer_indices(n, "early,middle,final")).alias("early"), csv(A.layer_indices(n, "first,middle,last")).alias("ends"))


# metrics


@query("""
WITH h AS (SELECT conv_id % 4 AS run, count(*) AS accepted FROM conversations GROUP BY conv_id) SELECT run, pos::INT AS pos,
 round(avg((accepted >= pos)::INT), 6) AS rate FROM h, range(1, 7) p(pos) GROUP BY run, pos""")
def head_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("accepted")).withColumn("run", F.col("conv_id") % 4)
    return metrics.head_acceptance(h, 6, by=["run"]).select("run", "pos", F.round("rate", 6).alias("rate"))


@query("""
WITH o AS (SELECT l_orderkey % 100 AS run, count(*) AS passes, sum(l_quantity) AS accepted, sum(l_quantity + 5) AS drafted,
 sum(l_extendedprice) / 1000 AS seconds, avg(l_quantity) AS mal FROM lineitem GROUP BY 1) SELECT run, round(mal, 5) AS mal, round(accepted / passes,
 5) AS speedup, round(accepted / greatest(drafted, 1), 5) AS acceptance_rate, round(accepted / greatest(seconds, 0.001), 5) AS tokens_per_second FROM o""")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("run")).agg(F.count(F.lit(1)).alias("passes"), F.sum("l_quantity").alias("accepted"), F.sum(F.col("l_quantity") + 5).alias("drafted"), (F.sum("l_extendedprice") / 1000).alias("seconds"), F.avg("l_quantity").alias("mal"))
    made = metrics.generation(*(F.col(c) for c in ("accepted", "passes", "drafted", "accepted", "seconds", "mal")))
    return o.select("run", *[F.round(v, 5).alias(k) for k, v in made.items()])


@query("""
WITH b AS (SELECT sum(l_quantity) / sum(l_extendedprice) AS base FROM lineitem WHERE l_returnflag = 'N'), m AS (SELECT l_linestatus,
 avg(l_quantity / l_extendedprice) AS tps FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_linestatus) SELECT l_linestatus, round(CASE
 WHEN base > 0 THEN tps / base ELSE 1.0 END, 5) AS speedup FROM m, b""")
def method_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of samples' speeds over the baseline's overall speed."""
    li = table(spark, sf_dir, "lineitem")
    base = li.where("l_returnflag = 'N'").agg(F.try_divide(F.sum("l_quantity"), F.sum("l_extendedprice")).alias("base"))
    m = li.where("l_returnflag <> 'N'").groupBy("l_linestatus").agg(F.avg(F.col("l_quantity") / F.col("l_extendedprice")).alias("tps"))
    return m.crossJoin(F.broadcast(base)).select("l_linestatus", F.round(F.when(F.col("base") > 0, F.col("tps") / F.col("base")).otherwise(1.0), 5).alias("speedup"))


@query("""
WITH h AS (SELECT o_custkey % 10 AS run, o_orderkey % 50 AS prompt, count(*) AS s, count(*) AS n, sum(length(o_orderpriority)) AS a FROM orders
 GROUP BY 1, 2) SELECT run, prompt, round(sum(a) OVER w / sum(n) OVER w, 6) AS mal FROM h WINDOW w AS (PARTITION BY run
 ORDER BY prompt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cumulative_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("run"), (F.col("o_orderkey") % 50).alias("prompt"), F.length("o_orderpriority").alias("accepted"))
    return metrics.cumulative_history(o, "run", "prompt", "accepted", compat=True, rows=16).withColumn("mal", F.round("mal", 6))


@query("""
SELECT event_type, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max,
 count(value) AS count FROM events GROUP BY event_type""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.series_summary(table(spark, sf_dir, "events"), ["event_type"])
    return s.select("event_type", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")], "count")


@query("""
SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY event_type) < 10 THEN value ELSE avg(value) OVER (PARTITION BY event_type ORDER BY ts,
 event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 5) AS smoothed FROM events""")
def smooth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.smooth(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], rows=500).select("event_id", F.round("smoothed", 5).alias("smoothed"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type,
 round(avg(value), 5) AS mean FROM r WHERE rn <= 100 GROUP BY event_type""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trailing_mean(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).withColumn("mean", F.round("mean", 5))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return e.groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("val"), F.round(F.avg(F.col("value") * (F.col("event_id") % 5)) / 2, 6).alias("train"))


DAILY = "d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS val, round(avg(value * (event_id % 5)) / 2, 6) AS train FROM events GROUP BY 1, 2)"


@query(f"""
WITH {DAILY}, b AS (SELECT *, min(val) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d),
 i AS (SELECT *, (best IS NULL OR val < best) AS improved FROM b), g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY event_type
 ORDER BY day) AS block FROM i), m AS (SELECT *, (row_number() OVER (PARTITION BY event_type, block ORDER BY day) - 1)::INT AS misses FROM g)
 SELECT event_type, day, improved, misses, max((misses >= 5)::INT) OVER (PARTITION BY event_type ORDER BY day) = 1 AS stopped,
 val > 1.5 * train AS overfit FROM m""")
def best_so_far_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.early_stopping(daily(spark, sf_dir), ["event_type"], "day", "val", "train", rows=10).select("event_type", "day", "improved", "misses", "stopped", "overfit")


@query("SELECT event_id, round(value, 6) AS value FROM events WHERE event_id % 10 = 0")
def step_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sampled_steps(table(spark, sf_dir, "events"), 10, "event_id").select("event_id", F.round("value", 6).alias("value"))


@query("""
WITH a AS (SELECT event_type AS metric, avg(value) AS x FROM events WHERE event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS metric,
 avg(value) AS y FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT coalesce(a.metric, b.metric) AS metric, round(coalesce(x, 0), 5) AS model1,
 round(coalesce(y, 0), 5) AS model2 FROM a FULL JOIN b ON a.metric = b.metric""")
def two_run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    both = metrics.compare(e.where("metric <> 'click'"), e.where("metric <> 'error'"), "metric", "v")
    return both.select("metric", F.round("model1", 5).alias("model1"), F.round("model2", 5).alias("model2"))


STEPS = "s AS (SELECT event_id // 5 AS step, event_id % 5 AS pos, user_id % 7 AS draft, user_id % 5 AS target, value AS draft_prob, value * (1 + event_id % 3) / 2 AS target_prob FROM events)"


@query(f"""
WITH {STEPS}, k AS (SELECT *, min(pos) FILTER (WHERE NOT (draft = target OR draft_prob >= 0.8 * target_prob)) OVER (PARTITION BY step) AS bad FROM s)
 SELECT step, pos, CASE WHEN pos = bad THEN target ELSE draft END AS token FROM k WHERE bad IS NULL OR pos <= bad""")
def verify_prefix_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = table(spark, sf_dir, "events").select(F.floor(e / 5).alias("step"), (e % 5).alias("pos"), (F.col("user_id") % 7).alias("draft"), (F.col("user_id") % 5).alias("target"), F.col("value").alias("draft_prob"), (F.col("value") * (1 + e % 3) / 2).alias("target_prob"))
    return metrics.accepted_prefix(s, ["step"]).select("step", "pos", "token")


@query("""
WITH x AS (SELECT event_id // 100 AS batch, event_id % 4 AS head, value AS error, (user_id % 3 > 0)::INT AS mask FROM events), h AS (SELECT batch,
 head, sum(error * mask) / (sum(mask) + 1e-8) AS loss FROM x GROUP BY 1, 2), b AS (SELECT batch, avg(loss) AS loss FROM h GROUP BY batch)
 SELECT round(avg(loss), 5) AS loss FROM b""")
def validation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("batch"), (F.col("event_id") % 4).alias("head"), F.col("value").alias("error"), (F.col("user_id") % 3 > 0).cast("int").alias("mask"))
    return metrics.validation_loss(x).select(F.round("loss", 5).alias("loss"))


@query(f"""
WITH s AS (SELECT event_type AS run, strftime(ts, '%Y-%m-%d') AS step, avg(value) AS value FROM events GROUP BY 1, 2) SELECT run, step, round(value,
 5) AS value, round(CASE WHEN count(*) OVER (PARTITION BY run) < 10 THEN value ELSE avg(value) OVER (PARTITION BY run
 ORDER BY step ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 5) AS smoothed, round(last_value(value) OVER (PARTITION BY run
 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 5) AS final, round(min(value) OVER (PARTITION BY run), 5) AS least,
 max(abs(value)) OVER (PARTITION BY run) = 0 AS all_zero FROM s""")
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").cast("string").alias("step")).agg(F.avg("value").alias("value"))
    c = metrics.training_curve(s, rows=16)
    return c.select("run", "step", *[F.round(x, 5).alias(x) for x in ("value", "smoothed", "final", "least")], "all_zero")


# tokens


FORM = "trim(regexp_replace(replace(replace({}, '''', '\"'), '\\n', chr(10)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"


@query(f"""WITH f AS (SELECT conv_id, turn, role, {FORM.format("text")} AS t FROM conversations),
w AS (SELECT conv_id, sum(len(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS n_tokens, sum(CASE WHEN role = 'assistant' THEN len(list_filter(string_split(t, ' '), lambda x: x <> '')) ELSE 0 END) AS n_trained FROM f GROUP BY conv_id) SELECT conv_id, n_tokens::INT AS n_tokens, n_trained::INT AS n_trained FROM w""")
def token_span_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated tokens of a conversation's text that lie within answers."""
    whole = T.matching_form(F.array_join(F.transform("messages", lambda m: m.content), "\n"))
    rows = talks(spark, sf_dir).withColumn("t", whole)
    rows = rows.withColumns({"tokens": masks.blank_tokens(F.col("t")), "spans": masks.trained_spans(F.col("t"), "messages")})
    k = rows.select("conv_id", masks.token_mask(F.col("tokens"), F.col("spans")).alias("k"))
    return k.select("conv_id", F.size("k").alias("n_tokens"), F.aggregate("k", F.lit(0), lambda a, x: a + x).alias("n_trained"))


@query(r"""
SELECT conv_id, count(*) = 0 AS empty, (sum((role = 'assistant')::INT) > 0) AS has_train, (count(*) > 0) AS has_messages FROM conversations
 GROUP BY conv_id""")
def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = talks(spark, sf_dir).withColumn("k", masks.loss_mask("messages"))
    return k.select("conv_id", (F.size("messages") == 0).alias("empty"), (F.size("k.train_indices") > 0).alias("has_train"), (F.size("k.segments") > 0).alias("has_messages"))


# estimates over the table of parts, whose names and sizes stand for models


@query("""
WITH p AS (SELECT p_partkey, (p_size / 10.0)::DOUBLE AS b, 512.0::DOUBLE * (1 + p_partkey % 8) AS h, (1 + p_partkey % 16)::DOUBLE AS n FROM part),
 x AS (SELECT *, b * 2 AS base, b * 2 * 0.01::DOUBLE AS lora, n * 2048 * 2048 * (CASE WHEN b >= 1.5 THEN 24
 ELSE 16 END) * 4 / 1073741824.0::DOUBLE AS act, 4 * n * 2048 * h * 4 / 1073741824.0::DOUBLE AS mtp, n * 2048 * h * 4 / 1073741824.0::DOUBLE AS cache
 FROM p) SELECT p_partkey, round(act + mtp, 1) AS working_gb, round(base + lora * 4 + act + mtp + cache + 2, 0) AS total_gb FROM x""")
def vram_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("b"), (512.0 * (1 + F.col("p_partkey") % 8)).alias("h"), (1 + F.col("p_partkey") % 16).cast("double").alias("n"))
    v = metrics.vram(F.col("b"), F.col("h"), F.col("n"))
    gib = float(1024**3)
    working = F.col("n") * 2048 * 2048 * F.when(F.col("b") >= 1.5, 24).otherwise(16) * 4 / gib + 4 * F.col("n") * 2048 * F.col("h") * 4 / gib
    exact = (F.col("b") * 2 * 1.04) + working + F.col("n") * 2048 * F.col("h") * 4 / gib + 2
    near = F.abs(v["total_required_gb"] - exact) < 0.011
    return p.select("p_partkey", F.round(working, 1).alias("working_gb"), F.when(near, F.round(exact, 0)).alias("total_gb"))


@query("""
SELECT p_partkey, ceil(p_partkey / (1 + p_size % 8))::BIGINT AS steps_per_epoch, (ceil(p_partkey / (1 + p_size % 8)) * 3)::BIGINT AS total_steps,
 round(ceil(p_partkey / (1 + p_size % 8)) * 3 / 1.5, 5) AS total_seconds FROM part""")
def training_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = metrics.training_time(F.col("p_partkey"), F.lit(3), 1 + F.col("p_size") % 8)
    return table(spark, sf_dir, "part").select("p_partkey", t["steps_per_epoch"].alias("steps_per_epoch"), t["total_steps"].alias("total_steps"), F.round(t["total_seconds"].cast("double"), 5).alias("total_seconds"))


@query(r"""
WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'model-' || p_size || 'B' WHEN 1 THEN 'mini-0.5' WHEN 2 THEN 'phi-3'
 WHEN 3 THEN p_name || '-7b' ELSE 'none' END AS name FROM part), r AS (SELECT *, regexp_extract(name, '(\d+\.?\d*)[Bb]', 1) AS d FROM n)
 SELECT p_partkey, CASE WHEN d <> '' THEN d::DOUBLE WHEN contains(name, '0.5') THEN 0.5 WHEN contains(name, '1.5') THEN 1.5 WHEN contains(name,
 '3') THEN 3.0 WHEN contains(name, '7') THEN 7.0 ELSE 1.5 END::DOUBLE AS billions FROM r""")
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat(F.lit("model-"), F.col("p_size").cast("string"), F.lit("B"))).when(k == 1, "mini-0.5").when(k == 2, "phi-3").when(k == 3, F.concat("p_name", F.lit("-7b"))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", T.model_size(name).alias("billions"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview FROM documents")
def doc_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("preview"))


# records of known shapes, made of the tables' texts


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN 2 ELSE 1 END::INT AS n_messages, CASE WHEN doc_id % 5 IN (2, 3) THEN 'user,assistant'
 ELSE 'user' END AS roles, md5(text) AS first FROM documents""")
def variant_format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every known shape, made of the table's texts, brought to messages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    k = F.col("doc_id") % 5
    shape = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    turn = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    record = (
        F.when(k == 0, shape(messages=F.array(turn)))
        .when(k == 1, shape(conversations=F.array(F.struct(F.lit("human").alias("from"), F.col("text").alias("value")))))
        .when(k == 2, shape(instruction=F.col("text"), output=F.col("source")))
        .when(k == 3, shape(query=F.col("text"), answers=F.lit("[{'name': 'look_up', 'arguments': {'n': 1}}]"), tools=F.lit("[]")))
        .otherwise(F.to_json(F.array(turn)))
    )
    return d.select("doc_id", C.dispatch_record(record).alias("m")).select("doc_id", F.size("m").alias("n_messages"), csv(F.transform("m", lambda x: x.role)).alias("roles"), F.md5(F.get("m", F.lit(0)).content).alias("first"))


@query("SELECT doc_id, 'call_' || doc_id || '_look_up' AS call_id, '{\"n\": ' || doc_id || '}' AS arguments, md5(text) AS asked FROM documents WHERE text <> '' AND doc_id % 2 = 0")
def function_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-calling records; every other one has no calls and goes."""
    d = table(spark, sf_dir, "documents")
    calls = F.concat(F.lit("[{'name': 'look_up', 'arguments': {'n': "), F.col("doc_id").cast("string"), F.lit("}}]"))
    record = F.to_json(F.struct(F.col("text").alias("query"), F.when(F.col("doc_id") % 2 == 0, calls).otherwise("none").alias("answers")))
    rows = d.select("doc_id", C.function_calling_messages(record, F.col("doc_id")).alias("m")).where("m is not null")
    call = F.get(F.get("m", F.lit(1)).tool_calls, F.lit(0))
    return rows.select("doc_id", call.id.alias("call_id"), call.function.arguments.alias("arguments"), F.md5(F.get("m", F.lit(0)).content).alias("asked"))


@query(f"""WITH {TALKS}, s AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m ELSE list_prepend({{role: 'system', content: '{MASTER_SYSTEM}'}}, m) END AS m FROM c),
p AS (SELECT *, lower(array_to_string(list_transform(list_filter(m, lambda x: x.role IN ('user', 'assistant', 'system')), lambda x: x.content), ' ')) AS t FROM s)
SELECT conv_id, CASE WHEN len(list_filter({quoted(ERROR_INDICATORS)}, lambda e: contains(t, e))) > 0 THEN 'error_content' WHEN len(list_filter(m, lambda x: x.role = 'assistant' AND length(x.content) >= 500)) = 0 THEN 'too_short' ELSE 'kept' END AS reason, len(m)::INT AS n_messages FROM p""")
def distill_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole distilling run over the table's conversations as logs, less the mask: each one's first failing stage."""
    logs = V.as_log(talks(spark, sf_dir).select(F.col("conv_id").alias("ord"), F.lit("local").alias("source"), "messages"))
    rows = pipelines.staged(logs, pipelines.Distill(min_response=500))
    return rows.select(F.col("ord").alias("conv_id"), F.coalesce("drop_reason", F.lit("kept")).alias("reason"), F.size("messages").alias("n_messages"))


@query("""
WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 1 DAY, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id
 ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts),
 '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.sessions(table(spark, sf_dir, "events"), "ts", "1 day", ["user_id"])
    return rows.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT event_type, round(avg(value), 5) AS mean, count(value) AS n FROM events GROUP BY event_type")
def stream_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = streams.drain(streams.running_mean(event_stream(spark, sf_dir), "event_type", "value"), "stream_running_mean", "complete")
    return done.select("event_type", F.round("mean", 5).alias("mean"), "n")


@query("SELECT lang, round(avg((trim(text) = trim(text[1:500]))::INT), 6) AS rate FROM documents GROUP BY lang")
def same_output_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(metrics.same_output(F.col("text"), F.substr("text", F.lit(1), F.lit(500))), 6).alias("rate"))


# no SQL has this


@query()
def seq_ratio_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(T.sequence_ratio("text", "other"), 6).alias("ratio"))


@query("SELECT item_id, 4 AS at FROM benchmark WHERE length(text) >= 24")
def fuzzy_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's 20 characters from the fifth, two of them changed, are found again."""
    b = table(spark, sf_dir, "benchmark").where(F.length("text") >= 24)
    pattern = F.concat(F.lit("\x01"), F.substr("text", F.lit(6), F.lit(18)), F.lit("\x02"))
    return b.select("item_id", T.fuzzy_find("text", pattern, F.lit(0)).alias("at"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "events")
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")  # a file or a folder


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.distinct(event_stream(spark, sf_dir).select("user_id"), "user_id"), "stream_dedup_events")


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streams.tumbling(event_stream(spark, sf_dir), "ts", "1 day", ["event_type"])
    done = streams.drain(counts, "stream_window_counts", "complete")
    return done.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
