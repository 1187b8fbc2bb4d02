"""Readers of trace dialects: nested span trees, OTLP JSON, dialogue histories and event logs.

All give canonical spans: trace_id, span_id, parent_span_id, span_name, span_kind, service_name, timestamp (ISO),
duration, status_code, status_message, attributes (map), place. Input rows have ``path`` and ``value``, the
file's text; what isn't of the dialect gives no spans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import json as js
from spanloom.functions import numbers, text

COLUMNS = ("trace_id", "span_id", "parent_span_id", "span_name", "span_kind", "service_name", "timestamp", "duration", "status_code", "status_message", "attributes", "place")
SPANS = "trace_id string, span_id string, parent_span_id string, span_name string, span_kind string, service_name string, timestamp string, duration string, status_code string, status_message string, attributes map<string,string>, place long"
VALUE = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
KV = f"array<struct<key:string,value:{VALUE}>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{KV}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{KV}>>>>>>"
# Codes of the wire format, and markers of a tool's failure in its output.
STATUS = {"0": "Unset", "1": "Ok", "2": "Error"}
KIND = {"0": "Unspecified", "1": "Internal", "2": "Server", "3": "Client", "4": "Producer", "5": "Consumer"}
FAILURES = r"traceback|exception|timeout|timed out|error:|failed|not found|permission denied"


def read_files(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Whole files as ``path``, ``value`` without a byte-order mark; by name, the first n if asked for."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return rows.orderBy("path").limit(first) if first is not None else rows


def decoded(code: Column, names: dict[str, str]) -> Column:
    """Names of numeric codes; other strings stay."""
    out = code
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def attribute_map(kv: Column) -> Column:
    """Attributes as a map of strings; the last of a repeated key counts."""
    pick = lambda v: F.coalesce(*[v[k] for k in ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")])
    return js.last_wins(F.transform(kv, lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), pick(e["value"]))))


def otlp_spans(files: DataFrame) -> DataFrame:
    """Spans of OTLP JSON, keys in camelCase or snake_case."""
    r = files.select(F.explode(F.from_json(js.camel_keys(F.col("value")), OTLP)["resourceSpans"]).alias("r"))
    s = r.select(attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s"))
    s = s.select("resource", F.posexplode("s.spans").alias("place", "x"))
    attributes = attribute_map(F.col("x.attributes"))
    status = F.coalesce(decoded(F.col("x.status.code"), STATUS), F.lit("Unset"))
    output = F.lower(F.coalesce(attributes["output.value"], F.lit("")))
    tool = attributes["tool.name"].isNotNull() | (attributes["openinference.span.kind"] == "TOOL")
    status = F.when((status == "Unset") & F.coalesce(tool, F.lit(False)) & output.rlike(FAILURES), "Error").otherwise(status)
    return s.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("span_name"),
        F.coalesce(decoded(F.col("x.kind"), KIND), F.lit("Unspecified")).alias("span_kind"), F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service_name"),
        F.coalesce(numbers.nanos_iso(F.col("x.startTimeUnixNano")), F.lit("")).alias("timestamp"), numbers.nanos_duration(F.col("x.startTimeUnixNano"), F.col("x.endTimeUnixNano")).alias("duration"),
        status.alias("status_code"), F.coalesce("x.status.message", F.lit("")).alias("status_message"), attributes.alias("attributes"), F.col("place").cast("long").alias("place"),
    )


TURN = "struct<role:string,name:string,agent:string,speaker:string,content:string,text:string,message:string,output:string>"
DIALOGUE = f"question_ID string, trace_id string, id string, task_id string, question string, task string, history array<{TURN}>, conversation array<{TURN}>, trajectory array<{TURN}>, messages array<{TURN}>"


def dialogue_spans(files: DataFrame) -> DataFrame:
    """A root and a span a turn, a tenth of a second apart; control turns go, but keep their place."""
    x = files.select(F.from_json("value", DIALOGUE).alias("x"), F.md5("value").alias("digest"))
    lists = [F.when(F.size(f"x.{c}") > 0, F.col(f"x.{c}")) for c in ("history", "conversation", "trajectory", "messages")]
    ids = [F.nullif(F.col(f"x.{c}"), F.lit("")) for c in ("question_ID", "trace_id", "id", "task_id")]
    x = x.select(F.coalesce(*ids, "digest").alias("trace_id"), F.coalesce("x.question", "x.task", F.lit("")).alias("task"), F.coalesce(*lists).alias("turns")).where("turns is not null")
    empty = F.create_map().cast("map<string,string>")
    root = x.select("trace_id", F.lit("dlg0000000000000").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("dialogue").alias("span_name"), F.map_concat(empty, F.create_map(F.lit("input.value"), F.col("task"))).alias("attributes"), F.lit(0).cast("long").alias("place"))
    t = x.select("trace_id", F.posexplode("turns").alias("i", "t")).where("t is not null")
    content = F.coalesce(*[F.nullif(F.col(f"t.{c}"), F.lit("")) for c in ("content", "text", "message", "output")], F.lit(""))
    speaker = text.canonical_speaker(F.coalesce(*[F.nullif(F.col(f"t.{c}"), F.lit("")) for c in ("name", "agent", "speaker")]), F.col("t.role"))
    t = t.where(~text.is_control_message(content))
    attributes = F.create_map(F.lit("chat.role"), F.coalesce("t.role", F.lit("")), F.lit("agent.name"), speaker, F.lit("output.value"), content, F.lit("conversation.step_index"), F.col("i").cast("string"))
    turns = t.select("trace_id", F.concat(F.lit("dlg"), F.lpad((F.col("i") + 1).cast("string"), 13, "0")).alias("span_id"), F.lit("dlg0000000000000").alias("parent_span_id"), speaker.alias("span_name"), attributes.alias("attributes"), (F.col("i") + 1).cast("long").alias("place"))
    rows = root.unionByName(turns)
    at = F.date_format(F.timestamp_micros(F.col("place") * 100_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select("trace_id", "span_id", "parent_span_id", "span_name", F.lit("Internal").alias("span_kind"), F.lit("dialogue").alias("service_name"), at.alias("timestamp"), F.lit("PT0.100000S").alias("duration"), F.lit("Ok").alias("status_code"), F.lit("").alias("status_message"), "attributes", "place")


EVENTS = "meta struct<trace_id:string,source_module:string>, events array<struct<label:string,at_ms:double,payload:struct<event_type:string,traceId:string,role:string,name:string,id:string,args:string,data:string,error:string,message:string,content:string>>>"


def event_log_spans(files: DataFrame) -> DataFrame:
    """A chain of spans, each the child of the one before; events of no known type are left out and don't break it."""
    x = files.select(F.from_json("value", EVENTS).alias("x"), F.md5("value").alias("digest"))
    x = x.select(F.coalesce("x.meta.trace_id", "digest").alias("trace_id"), F.posexplode("x.events").alias("place", "e"))
    kind = F.col("e.payload.event_type")
    # Event types that become spans.
    names = {"chat.tracer_agent": "agent", "tool.use": "tool", "chat.error": "error", "team.error": "error", "chat.final": "final"}
    name = F.lit(None).cast("string")
    for k, v in names.items():
        name = F.when(kind == k, v).otherwise(name)
    x = x.withColumn("kind", name).where("kind is not null").withColumn("span_id", js.stable_id(F.col("trace_id"), F.col("place"), F.col("kind")))
    error = F.coalesce("e.payload.error", F.when(F.col("kind") == "error", F.col("e.payload.message")))
    pairs = {"event.type": kind, "chat.role": F.col("e.payload.role"), "tool.name": F.when(F.col("kind") == "tool", F.col("e.payload.name")), "input.value": F.col("e.payload.args"), "output.value": F.coalesce("e.payload.data", "e.payload.content", "e.payload.message")}
    attributes = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*pairs.values())), lambda k, v: v.isNotNull())
    at = F.date_format(F.timestamp_micros((F.col("e.at_ms") * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    before = F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("place"))
    return x.select("trace_id", "span_id", before.alias("parent_span_id"), F.coalesce("e.payload.name", "e.label", "kind").alias("span_name"), F.lit("Internal").alias("span_kind"), F.lit("event-log").alias("service_name"), F.coalesce(at, F.lit("")).alias("timestamp"), F.lit("").alias("duration"), F.when(error.isNotNull(), "Error").otherwise("Ok").alias("status_code"), F.coalesce(error, F.lit("")).alias("status_message"), attributes.alias("attributes"), F.col("place").cast("long").alias("place"))


def _flatten(trace: dict) -> Iterator[tuple]:
    """Preorder of a nested span tree; a nested span without a parent id is its holder's child."""
    stack = [(s, None) for s in reversed(trace.get("spans") or []) if isinstance(s, dict)]
    place = 0
    while stack:
        span, holder = stack.pop()
        attributes = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in (span.get("span_attributes") or span.get("attributes") or {}).items()}
        own = str(span.get("span_id") or "")
        yield (str(trace.get("trace_id") or ""), own, span.get("parent_span_id") or holder, span.get("span_name") or span.get("name") or "", span.get("span_kind") or "", span.get("service_name") or "", span.get("timestamp") or "", str(span.get("duration") or ""), span.get("status_code") or "Unset", span.get("status_message") or "", attributes, place)
        place += 1
        stack += [(c, own) for c in reversed(span.get("child_spans") or span.get("children") or []) if isinstance(c, dict)]


def tree_spans(files: DataFrame) -> DataFrame:
    """Spans of nested trees; these are of no fixed depth, so Python walks them in Arrow batches."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 10 + [pa.map_(pa.string(), pa.string()), pa.int64()]
        for batch in batches:
            rows = []
            for value in batch.column("value").to_pylist():
                try:
                    trace = json.loads(value)
                except (TypeError, ValueError):
                    continue
                if isinstance(trace, dict) and isinstance(trace.get("spans"), list):
                    rows += [(*r[:10], list(r[10].items()), r[11]) for r in _flatten(trace)]
            cols = list(zip(*rows, strict=True)) or [()] * 12
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(COLUMNS))

    return files.select("value").mapInArrow(walk, SPANS)


def dialect(value: Column) -> Column:
    """Which dialect a file is of: tree, otlp, dialogue or events; null if none."""
    v = F.try_parse_json(value)
    has = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths]).isNotNull()
    return F.when(has("$.spans[0].span_id", "$.spans[0].child_spans"), "tree").when(has("$.resourceSpans[0]", "$.resource_spans[0]"), "otlp").when(has("$.history[0]", "$.conversation[0]", "$.trajectory[0]", "$.messages[0]"), "dialogue").when(has("$.events[0]"), "events")


def read_traces(files: DataFrame) -> DataFrame:
    """Spans of files of any dialect, each read by its own reader."""
    rows = files.withColumn("dialect", dialect(F.col("value")))
    of = lambda name: rows.where(F.col("dialect") == name)
    return tree_spans(of("tree")).unionByName(otlp_spans(of("otlp"))).unionByName(dialogue_spans(of("dialogue"))).unionByName(event_log_spans(of("events")))


# Columns that may hold a trace or an annotation, by rank.
TRACE_COLUMNS = ("trace", "trace_json", "otel_trace", "gaia_trace", "raw_trace", "trace_content", "output")


def trace_column(rows: DataFrame) -> Column:
    """The first non-empty of the columns that may hold a trace."""
    held = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in TRACE_COLUMNS if c in rows.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")
