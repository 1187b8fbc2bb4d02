"""JSON expressions: key styles, attribute lists, messages, and lenient parsing."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of the OTLP wire format.
OTLP_KEYS = ("resourceSpans", "scopeSpans", "traceId", "spanId", "parentSpanId", "startTimeUnixNano", "endTimeUnixNano", "timeUnixNano", "stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")


def camel_keys(text: Column) -> Column:
    """OTLP JSON with its snake_case keys in camelCase."""
    for key in OTLP_KEYS:
        snake = re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), key)
        text = F.regexp_replace(text, rf'"{snake}"(\s*):', f'"{key}"$1:')
    return text


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value), of which the last counts for repeated keys."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.when(entries.isNotNull(), F.map_from_arrays(keys, values)).otherwise(F.create_map().cast("map<string,string>"))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces, or the stripped text where it isn't JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.trim(text))


def stable_id(*parts: Column) -> Column:
    """Sixteen hex digits that the parts fix."""
    return F.left(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(16))


def balanced(text: str) -> str | None:
    """The first object in a text that parses as JSON."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            _, end = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        return text[m.start() : end]
    return None


def lenient(text: str | None) -> str | None:
    """Canonical JSON of an object in a model's answer: fenced, with trailing commas, quoted as a string, or a Python literal."""
    if not text:
        return None
    tries = [m[1] for m in re.finditer(r"```(?:json)?\s*(.*?)```", text, re.S)] + [text, balanced(text) or ""]
    for part in tries:
        for made in (part.strip().lstrip("﻿"), re.sub(r",(\s*[}\]])", r"\1", part.strip())):
            for _ in range(3):
                try:
                    value = json.loads(made)
                except ValueError:
                    try:
                        value = ast.literal_eval(made)
                    except (ValueError, SyntaxError, MemoryError, RecursionError):
                        break
                if isinstance(value, dict):
                    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
                if not isinstance(value, str):
                    break
                made = value
    return None


def lenient_json(text: Column) -> Column:
    """``lenient`` for each text of a column, in Arrow batches."""

    def parse(values: pd.Series) -> pd.Series:
        return values.map(lenient)

    return F.pandas_udf(parse, "string")(text)


MESSAGES = "array<struct<role:string,content:string,parts:array<struct<content:string>>,tool_call_id:string,tool_calls:array<string>>>"


def messages(text: Column) -> Column:
    """A message list parsed from JSON; null where it isn't one."""
    return F.from_json(text, MESSAGES)


def message_text(message: Column) -> Column:
    """Text of a message: its content and its parts' contents, in lines."""
    own = F.array_compact(F.array(message["content"]))
    parts = F.array_compact(F.transform(F.coalesce(message["parts"], F.array().cast("array<struct<content:string>>")), lambda p: p["content"]))
    return F.array_join(F.concat(own, parts), "\n")
