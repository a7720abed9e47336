"""Projections and filters on conversations: rows with ``messages``, an array of MESSAGE.

All are native column functions; nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions import content as C
from chatloom.functions import text as T
from chatloom.functions.bind import let
from chatloom.functions.schemas import CODE_REQUESTS, DEFAULT_SYSTEM, ERROR_INDICATORS, FILLER_LINE, FILLERS, GENERIC_SYSTEM, MASTER_SYSTEM, MESSAGE, MESSAGES, SHAREGPT


def body(m: Column) -> Column:
    return F.coalesce(m.content, F.lit(""))


def system(prompt: str) -> Column:
    return F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"), F.lit(None).alias("tool_calls")).cast(MESSAGE)


def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in the order of turns (ties by role and text)."""
    row = F.struct(F.col(turn).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(row)), lambda m: F.struct(m.role.alias("role"), m.content.alias("content"), F.lit(None).alias("tool_calls")))
    return turns.groupBy(conv).agg(messages.cast(MESSAGES).alias("messages"))


def has_tools(m: Column) -> Column:
    return F.coalesce(F.size(m.tool_calls) > 0, F.lit(False))


def first_of(messages: Column | str, role: str, filled: bool = False) -> Column:
    """Content of the first message of a role (with content, if ``filled``), or null."""
    test = (lambda m: (m.role == role) & (body(m) != "")) if filled else (lambda m: m.role == role)
    return F.get(F.filter(messages, test), F.lit(0)).content


# format conversion


def call_lines(m: Column, before: str, after: str = ")") -> Column:
    calls = F.coalesce(m.tool_calls, F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))
    return F.transform(calls, lambda c: F.concat(F.lit(before), F.coalesce(c.function["name"], F.lit("")), F.lit("("), F.coalesce(c.function.arguments, F.lit("")), F.lit(after)))


def to_sharegpt(messages: Column | str) -> Column:
    """Human and gpt turns, tool calls written out; null if none has text."""
    def turn(m: Column) -> Column:
        calls = F.when((m.role == "assistant") & has_tools(m), F.concat(F.lit("\n[Tool Calls]:\n"), F.array_join(call_lines(m, "- ", ")\n"), ""))).otherwise(F.lit(""))
        return F.struct(F.when(m.role == "assistant", "gpt").otherwise("human").alias("from"), F.concat(body(m), calls).alias("value"))

    known = F.filter(messages, lambda m: m.role.isin("system", "user", "assistant", "tool"))
    turns = F.filter(F.transform(known, turn), lambda t: t["value"] != "").cast(SHAREGPT)
    return F.when(F.size(turns) > 0, turns)


def from_sharegpt(conversations: Column | str) -> Column:
    """Messages of human and gpt turns with text; other turns are skipped; null if none is left."""
    known = F.filter(conversations, lambda t: t["from"].isin("human", "gpt") & (F.coalesce(t["value"], F.lit("")) != ""))
    messages = F.transform(known, lambda t: F.struct(F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"), t["value"].alias("content"), F.lit(None).alias("tool_calls"))).cast(MESSAGES)
    return F.when(F.size(messages) > 0, messages)


def training_input(messages: Column | str) -> Column:
    kept = F.filter(messages, lambda m: m.role.isin("system", "user", "tool") & (body(m) != ""))
    return F.array_join(F.transform(kept, lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n")


def training_output(messages: Column | str) -> Column:
    def lines(m: Column) -> Column:
        said = F.when(body(m) != "", F.array(F.concat(F.lit("assistant: "), m.content))).otherwise(F.array().cast("array<string>"))
        return F.concat(call_lines(m, "[TOOL_CALL] "), said)

    return F.array_join(F.flatten(F.transform(F.filter(messages, lambda m: m.role == "assistant"), lines)), "\n")


def tagged_text(messages: Column | str) -> Column:
    kept = F.filter(messages, lambda m: body(m) != "")
    return F.array_join(F.transform(kept, lambda m: F.concat(F.lit("<"), m.role, F.lit(">"), m.content, F.lit("</"), m.role, F.lit(">"))), "\n")


def log_messages(conversation: Column, response: Column) -> Column:
    """Messages of a log record: roles and contents only, and the response if it has text."""
    bare = F.transform(F.coalesce(conversation.messages, F.array().cast(MESSAGES)), lambda m: F.struct(F.coalesce(m.role, F.lit("user")).alias("role"), m.content.alias("content"), F.lit(None).alias("tool_calls"))).cast(MESSAGES)
    said = F.struct(F.lit("assistant").alias("role"), response.content.alias("content"), F.lit(None).alias("tool_calls")).cast(MESSAGE)
    return F.when(F.coalesce(response.content, F.lit("")) != "", F.concat(bare, F.array(said))).otherwise(bare)


def as_log(rows: DataFrame) -> DataFrame:
    """Wrap samples as successful log records; their true source stays."""
    return rows.select("*", F.lit("SUCCESS").alias("type"), F.struct("messages").alias("conversation"), F.struct(F.lit(None).cast("string").alias("content")).alias("response"))


def samples(records: DataFrame, record: str = "record", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records' JSON text -> messages, input_text and output_text; malformed and empty records go.

    transform: from a frame with ``record`` to one with ``messages``; dispatch of known shapes by default.
    """
    made = transform(records) if transform else records.withColumn("messages", C.dispatch_record(F.col(record)))
    made = made.where(F.size("messages") > 0)
    return made.withColumns({"input_text": training_input("messages"), "output_text": training_output("messages")})


# enrichment


def with_system(messages: Column | str, local: Column, master: str = MASTER_SYSTEM) -> Column:
    """Messages that start with a system prompt: one's own on local sources, unless it is generic elsewhere."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    first = F.get(messages, F.lit(0))
    own = F.coalesce(first.role == "system", F.lit(False))
    generic = T.contains_any(body(first), GENERIC_SYSTEM)
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    new = F.array(system(master))
    return F.when(own & (local | ~generic), messages).when(own, F.concat(new, rest)).otherwise(F.concat(new, F.coalesce(messages, F.array().cast(MESSAGES))))


def fillers(system_text: Column) -> Column:
    """Phrases that a system prompt asks to leave out, else the default ones."""
    parts = F.transform(F.split(F.regexp_extract(F.coalesce(system_text, F.lit("")), FILLER_LINE, 1), r"[,;|]+"), T.strip)
    found = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.trim(F.trim(p, F.lit('"')), F.lit("'")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, FILLERS)))


def without_fillers(messages: Column | str, phrases: Column) -> Column:
    """Assistant messages without the first listed filler that they start with, and the blanks after it."""
    def trimmed(m: Column, phrases: Column) -> Column:
        start = F.filter(phrases, lambda p: F.startswith(F.lower(m.content), F.lower(p)))
        rest = F.substr(m.content, F.length(F.get(start, F.lit(0))) + 1)
        text = F.when((m.role == "assistant") & (F.size(start) > 0), F.ltrim(rest, F.lit(T.BLANKS))).otherwise(m.content)
        return F.struct(m.role.alias("role"), text.alias("content"), m.tool_calls.alias("tool_calls"))

    return let(phrases, lambda held: F.transform(messages, lambda m: trimmed(m, held)))


def clean(rows: DataFrame, source: str = "source", defaulted: str = "huggingface") -> DataFrame:
    """Drop empty messages, and give ``drop_reason`` (null: kept); sources named ``defaulted`` get a default system prompt."""
    kept = F.filter("messages", lambda m: (body(m) != "") | has_tools(m))
    has = lambda role: F.exists("_kept", lambda m: m.role == role)
    reason = F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "invalid_format").when(~has("user"), "missing_user").when(~has("assistant"), "missing_assistant")
    add = (F.col(source) == defaulted) & ~has("system")
    out = rows.withColumn("_kept", kept).withColumn("drop_reason", reason)
    return out.withColumn("messages", F.when(F.coalesce(add, F.lit(False)), F.concat(F.array(system(DEFAULT_SYSTEM)), F.col("_kept"))).otherwise(F.col("_kept"))).drop("_kept")


def clean_triple(rows: DataFrame, min_words: int = 10) -> DataFrame:
    """First system, first user and last assistant text, trimmed, and ``reason``: valid, or what is missing."""
    def said(m: Column) -> Column:
        names = F.transform(m.tool_calls, lambda c: F.coalesce(c.function["name"], F.lit("unknown")))
        return F.when((body(m) == "") & has_tools(m), F.concat(F.lit("[Calling tools: "), F.array_join(names, ", "), F.lit("]"))).otherwise(body(m))

    fence = lambda c: T.strip(F.regexp_replace(F.regexp_replace(T.strip(c), r"(?s)```json\s*(.*?)\s*```", "$1"), r"(?s)```\s*(.*?)\s*```", "$1"))
    answers = F.filter(F.transform(F.filter("messages", lambda m: m.role == "assistant"), lambda m: fence(said(m))), lambda t: t != "")
    out = rows.withColumns({"system_text": T.strip(first_of("messages", "system")), "user_text": T.strip(first_of("messages", "user")), "_answers": answers})
    out = out.withColumn("assistant_text", F.when(F.size("_answers") > 0, F.element_at("_answers", -1))).drop("_answers")
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(missing("system_text"), "missing_system")
        .when(missing("user_text"), "missing_user")
        .when(missing("assistant_text"), "missing_assistant")
        .when(F.size(T.words(F.col("assistant_text"))) < min_words, "too_short")
        .otherwise("valid")
    )
    return out.withColumn("reason", reason)


# filters: each gives true where a conversation stays


def status_ok(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("")) == "SUCCESS"


def no_error_content(messages: Column | str) -> Column:
    said = F.filter(messages, lambda m: m.role.isin("user", "assistant", "system"))
    return ~T.contains_any(F.array_join(F.transform(said, body), " "), ERROR_INDICATORS)


def tools_intact(messages: Column | str) -> Column:
    """No tool call that is answered, at once, by one of the first five error indicators."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    failed = F.filter(messages, lambda m, i: (m.role == "assistant") & has_tools(m) & F.coalesce(F.get(messages, i + 1).role == "tool", F.lit(False)) & F.coalesce(T.contains_any(body(F.get(messages, i + 1)), ERROR_INDICATORS[:5]), F.lit(False)))
    return F.size(failed) == 0


def asks_for_code(messages: Column | str) -> Column:
    return T.contains_any(F.coalesce(first_of(messages, "user"), F.lit("")), CODE_REQUESTS)


def code_answered(messages: Column | str) -> Column:
    return ~asks_for_code(messages) | F.contains(F.coalesce(first_of(messages, "assistant"), F.lit("")), F.lit("```"))


def long_enough(messages: Column | str, least: int = 30) -> Column:
    return F.exists(messages, lambda m: (m.role == "assistant") & (F.length(body(m)) >= least))


def uses_tools(messages: Column | str) -> Column:
    return F.exists(messages, lambda m: (m.role == "assistant") & has_tools(m))


def enough_words(messages: Column | str, least: int) -> Column:
    """The first assistant message with content has so many words; conversations without one stay."""
    first = first_of(messages, "assistant", filled=True)
    return first.isNull() | (F.size(T.words(first)) >= least) if least > 0 else F.lit(True)


def first_reason(tests: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first test that is true, in this order, or null."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out
