"""Normalising heterogeneous message content.

Content arrives as the JSON text of its value. Plain strings, by far the most, take a
native path; only structured content goes through an Arrow-batched function, since
Python literals and the ``str()`` of containers have no built-in counterpart.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.functions.schemas import MESSAGES

class FAILED:
    """What from_json gives for text that isn't JSON. A class, since it is the same one in every worker."""


def from_json(text: str) -> Any:
    try:
        return json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return FAILED


def from_literal(text: str) -> Any:
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return FAILED


def is_message(x: Any) -> bool:
    return isinstance(x, dict) and "role" in x


def picked(items: list, keys: tuple[str, ...]) -> list[str]:
    """Of each dict the value of the first key it has."""
    found = ((next((d[k] for k in keys if k in d), FAILED)) for d in items if isinstance(d, dict))
    return [str(v) for v in found if v is not FAILED]


def transcript(messages: list) -> str:
    """Lines ``role: content`` of a list of messages; list content is its texts joined by blanks."""
    lines = []
    for m in messages:
        body = m.get("content", "")
        if isinstance(body, list):
            body = " ".join(picked(body, ("text",))) or None
        if isinstance(body, str):
            lines.append(f"{m.get('role', 'unknown')}: {body}")
    return "\n".join(lines)


def deep_text(x: Any) -> str:
    """Normaliser 1: any content to text, strings that hold JSON included."""
    match x:
        case None:
            return ""
        case str() if x[:1] in ("[", "{") and (inner := from_json(x)) is not FAILED:
            return deep_text(inner)
        case str():
            return x
        case [dict() as first, *_] if "role" in first and "content" in first:
            return transcript([m for m in x if isinstance(m, dict)])
        case [dict(), *_]:
            return "\n".join(picked(x, ("text", "value")))
        case {"role": role, "content": inner}:
            return f"{role}: {deep_text(inner)}"
    return str(x)


def block_text(x: Any) -> str:
    """Normaliser 2: texts of a list's blocks joined by blanks; strings stay as they are."""
    if isinstance(x, list):
        return " ".join(str(b["text"]) for b in x if isinstance(b, dict) and "text" in b)
    return "" if x is None else x if isinstance(x, str) else str(x)


def feature_text(x: Any) -> str:
    """Normaliser 3: as feature extraction reads content; typed block lists may be written as a string."""
    if isinstance(x, list):
        return " ".join(picked(x, ("text", "content")))
    if not isinstance(x, str):
        return "" if x is None else str(x)
    body = x.strip()
    if not body.startswith("[") or not re.search("'type'|\"type\"", body):
        return x
    blocks = from_literal(body)
    if isinstance(blocks, list):
        return " ".join(picked(blocks, ("text",)))
    if blocks is FAILED and isinstance(blocks := from_json(body.replace("'", '"')), list):
        return " ".join(str(b.get("text", "")) for b in blocks if isinstance(b, dict))
    return x


FENCES = (re.compile(r"```json\s*(.*?)\s*```", re.S), re.compile(r"```\s*(.*?)\s*```", re.S))


def unfenced(x: Any) -> str | None:
    """Normaliser 4: without code fences; JSON inside is flattened or indented."""
    if not x or not isinstance(x, str):
        return None
    body = x.strip()
    for fence in FENCES:
        body = fence.sub(lambda m: m[1], body)
    body = body.strip()
    inner = from_json(body)
    if isinstance(inner, dict):
        return json.dumps(inner, indent=2)
    if isinstance(inner, list) and all(isinstance(v, str) for d in inner if isinstance(d, dict) for v in (d.get("text", ""), d.get("value", ""))):
        return "\n".join(picked(inner, ("text", "value"))) or body
    return body


def nested(x: Any) -> list[dict]:
    """Messages written as a string inside a message: a Python literal, else JSON."""
    if not isinstance(x, str):
        return []
    value = from_literal(x)
    value = from_json(x) if value is FAILED else value
    if isinstance(value, dict):
        value = value.get("messages", [])
    return [{"role": m["role"], "content": deep_text(m.get("content"))} for m in value if is_message(m)] if isinstance(value, list) else []


def tool_list(x: Any) -> list:
    """Tool calls written as a JSON list, else as a Python list, else none."""
    if isinstance(x, str):
        for read in (from_json, from_literal):
            if isinstance(value := read(x), list):
                return value
    return []


def as_call(call: dict, ident: str) -> dict:
    arguments = call.get("arguments", {})
    name = call.get("name", "")
    return {"id": f"call_{ident}_{name}", "type": "function", "function": {"name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments)}}


def dispatch(record: Any) -> list[dict] | None:
    """Messages of a record of any known shape, by the first shape that fits; None if it is malformed."""
    if isinstance(record, list):
        own = [{**m, "content": deep_text(m.get("content"))} for m in record if is_message(m)]
        return own or [{"role": "user", "content": str(record)}]
    if not isinstance(record, dict):
        return None
    if "messages" in record:
        out: list[dict] = []
        for m in record["messages"]:
            out += nested(m.get("content", "")) or [{**m, "content": deep_text(m.get("content", ""))}]
        return out
    if "conversations" in record:
        return [{"role": "user" if t["from"] == "human" else "assistant", "content": t["value"]} for t in record["conversations"]]
    if {"instruction", "output"} <= record.keys():
        return [{"role": r, "content": record[k]} for r, k in (("user", "instruction"), ("assistant", "output"))]
    if {"query", "answers"} <= record.keys():
        calls = [as_call(c, str(i)) for i, c in enumerate(tool_list(record["answers"]))]
        asked = [{"role": "user", "content": record["query"]}]
        return asked + [{"role": "assistant", "content": None, "tool_calls": calls}] if calls else asked
    return [{"role": "user", "content": str(record)}]


def plain(messages: list[dict] | None) -> str | None:
    """Messages as JSON of the engine's schema."""
    if messages is None:
        return None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    out = []
    for m in messages:
        calls = [
            {"id": c.get("id"), "type": c.get("type"), "function": {k: text(c.get("function", {}).get(k)) for k in ("name", "arguments")}}
            for c in m.get("tool_calls") or []
            if isinstance(c, dict)
        ]
        out.append({"role": text(m.get("role")), "content": text(m.get("content")), "tool_calls": calls or None})
    return json.dumps(out, ensure_ascii=False)


def over_json(f: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A column function from JSON text to text; a value that can't be read, or on which f fails, gives null."""

    def one(text: str | None) -> str | None:
        if text is None or (value := from_json(text)) is FAILED:
            return None
        try:
            return f(value)
        except (KeyError, TypeError, AttributeError, ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def batch(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return lambda column: batch(column)


def normalizer(f: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A column function from content (JSON text of the value) to text. Simple strings never leave the JVM."""
    slow = over_json(f)

    def column(c: Column) -> Column:
        simple = c.rlike(r'^"[^\\\[{`]*"$') & ~c.rlike(r'^"\s|\s"$|^""$')
        return F.when(simple, F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(slow(F.when(simple, F.lit(None)).otherwise(c)))

    return column


normalize_content = normalizer(deep_text)
content_string = normalizer(block_text)
parse_content = normalizer(feature_text)
clean_content = normalizer(unfenced)


def dispatch_record(record: Column) -> Column:
    """Messages (array of MESSAGE) of a record's JSON text; null if it is malformed."""
    return F.from_json(over_json(lambda x: plain(dispatch(x)))(record), MESSAGES)


def parse_tool_calls(answers: Column) -> Column:
    """JSON text of the list of calls in a string."""
    return over_json(lambda x: json.dumps(tool_list(x)))(F.to_json(F.array(answers)).substr(F.lit(2), F.length(F.to_json(F.array(answers))) - 2))


def function_calling_messages(record: Column, index: Column) -> Column:
    """Messages of a {query, answers, tools} record, calls numbered by the record's index; null without query or calls."""

    @F.pandas_udf(StringType())
    def batch(records: pd.Series, indexes: pd.Series) -> pd.Series:
        def one(text: str | None, i: int) -> str | None:
            r = from_json(text) if text else None
            if not isinstance(r, dict) or not r.get("query"):
                return None
            calls = [as_call(c, str(i)) for c in tool_list(r.get("answers")) if isinstance(c, dict)]
            return plain([{"role": "user", "content": r["query"]}, {"role": "assistant", "content": None, "tool_calls": calls}]) if calls else None

        return pd.Series([one(r, i) for r, i in zip(records, indexes, strict=True)], dtype=object)

    return F.from_json(batch(record, index), MESSAGES)
