"""Nodes of a trace by the names and attributes of its spans: what each span says, did, was told, and got wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import validation

# How prompts ask for a tag, and words of failure in names and messages.
TAG_REQUEST = r"(?i)write the ['\"]?(?:\\n)?(<[^>\s]+>)['\"]? tag and stop there"
ERROR_WORDS = r"error|exception|traceback|failed|invalid|unexpected keyword|timeout"
#: Characters of a node's text at most.
CONTENT = 5000


def looks_like_error(t: Column) -> Column:
    """Whether a text speaks of a failure; ``error: none`` and the like don't count."""
    bare = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"\berror\b\s*[:=]\s*(?:none|null|false|['\"]{2})", "")
    return (text.strip(F.coalesce(t, F.lit(""))) != "") & bare.rlike(ERROR_WORDS)


def tool_error_text(status: Column, result: Column) -> Column:
    """Whether a tool result reads like a failure where its span has no status of its own."""
    unset = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("", "unset", "status_code_unset", "status_code_unspecified")
    return unset & F.lower(F.coalesce(result, F.lit(""))).rlike(r"\[error\]|success=false|traceback|exception|failed|timeout|cannot find|not recognized")


def output_type(t: Column) -> Column:
    """Type of what a model said: a conclusion, a plan or a fact by its markers, else a plan."""
    up = F.upper(t)
    has = lambda c, w: F.contains(c, F.lit(w))
    return F.when(has(up, "FINAL ANSWER:") | has(t, "final_answer("), "Conclusion").when(has(t, "[PLAN]") | has(up, "### 1. FACTS") | has(up, "FACTS GIVEN"), "Planning").when(has(up, "OBSERVATION") | has(up, "EXECUTION LOGS"), "Fact").otherwise("Planning")


def requested_tags(prompt: Column, value: Column) -> Column:
    """Tags that a prompt or the stop sequences of a model's input ask for, in order of the alphabet."""
    asked = F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(TAG_REQUEST), 1)
    stops = F.from_json(F.get_json_object(value, "$.stop_sequences"), "array<string>")
    held = F.filter(F.transform(F.coalesce(stops, F.array().cast("array<string>")), text.strip), lambda x: x.rlike(r"^<[^>\s]+>$"))
    return F.array_sort(F.array_distinct(F.concat(asked, held)))


def argument_fault(arguments: Column, parameters: Column) -> Column:
    """What is wrong with a call's keyword arguments: an empty name, or any where none are known; null if nothing."""
    named = F.from_json(F.get_json_object(arguments, "$.kwargs"), "map<string,string>")
    known = F.json_object_keys(parameters)
    return F.when(F.map_contains_key(named, ""), "called with empty argument key in kwargs").when((F.size(known) == 0) & (F.size(F.map_keys(named)) > 0), "expects empty params but received kwargs")


def suspicious_spans(spans: DataFrame) -> DataFrame:
    """Spans (trace_id, span_id, pos, name, status, status_message, attributes) with what is suspicious about each: kind and evidence, a row each."""
    a = F.col("attributes")
    out, given = F.coalesce(a["output.value"], F.lit("")), F.coalesce(a["input.value"], F.lit(""))
    mark = lambda when, kind, evidence: F.when(when, F.struct(F.lit(kind).alias("kind"), F.left(evidence, F.lit(260)).alias("evidence")))
    found = F.array_compact(F.array(
        mark(F.col("name").startswith("Step ") & F.lower(out).rlike("error|failed|exception"), "step_output_error_keyword", out),
        mark(F.lower("status") == "error", "span_status_error", F.coalesce(F.nullif(F.col("status_message"), F.lit("")), F.lit("status_code=Error"))),
        mark(F.contains(given, F.lit('"kwargs": {"": ""}')), "invalid_tool_kwargs", given),
    ))
    return spans.select("trace_id", "span_id", "pos", F.explode(found).alias("f")).select("trace_id", "span_id", "pos", "f.*")


def nodes(spans: DataFrame, finals: DataFrame) -> DataFrame:
    """Nodes (trace_id, node_id, ord, type, content, span_id, parent_id, ts) of canonical spans in preorder (``pos``).

    Spans have name, status, status_message, attributes; ``events`` (array of name, attributes) and ``logs`` (array of name, arguments, output)
    may be absent. Outputs of the spans in ``finals`` (trace_id, final_id) are conclusions. A span that gives no node by these rules gives one
    by its role. Ids run by type, in order, before any node is dropped. Empty texts give none.
    """
    a, name, status = F.col("attributes"), F.col("name"), F.col("status")
    get = lambda k: F.coalesce(a[k], F.lit(""))
    node = lambda when, rule, kind, content: F.when(when, F.struct((rule if isinstance(rule, Column) else F.lit(rule)).cast("int").alias("rule"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), content.alias("content")))
    rows = spans.join(finals.select("trace_id", F.col("final_id").alias("span_id")).distinct().withColumn("_final", F.lit(True)), ["trace_id", "span_id"], "left")
    final = F.coalesce("_final", F.lit(False))
    model, step = name == "LiteLLMModel.__call__", name.startswith("Step ")
    tool = F.map_contains_key(a, "tool.name") | (get("openinference.span.kind") == "TOOL") | name.endswith("Tool")
    told, said, result = get("input.value"), get("llm.output_messages.0.message.content"), get("output.value")
    label = F.coalesce(a["tool.name"], name)
    missing = F.filter(requested_tags(a["llm.input_messages.0.message.content"], told), lambda t: ~F.contains(said, t))
    state = validation.tool_status(status, result)
    empty = text.strip(result).isin("", "<null>", "[]", "{}")
    why = F.coalesce(F.when(F.json_object_keys(result).isNotNull(), F.nullif(F.get_json_object(result, "$.error"), F.lit(""))), F.left(result, F.lit(1200)))
    fault = argument_fault(told, get("tool.parameters"))
    message = F.coalesce("status_message", F.lit(""))
    ruled = [
        node((F.lower(status) == "error") | looks_like_error(message), 0, "Error", F.when(message != "", message).otherwise(F.concat(F.lit("SpanError: "), name))),
        node((name == "CodeAgent.run") & (told != ""), 1, "Intent", F.coalesce(F.get_json_object(told, "$.task"), told)),
        node(model & (said != ""), 1, F.when(final, "Conclusion").otherwise(output_type(said)), said),
        node(model & (said != "") & (F.size(missing) > 0), 2, "Error", F.concat(F.lit("FormattingError: missing required tag(s) "), F.array_join(missing, ", "), F.lit(" in LLM output"))),
        node(step & (result != ""), 1, "Fact", result),
        node(tool, 3, "Action", F.concat(F.lit("Tool: "), label, F.lit(" | Args: "), told, F.lit(" | Params: "), get("tool.parameters"))),
        node(tool & fault.isNotNull(), 4, "Error", F.concat(F.lit("ToolArgError: "), label, F.lit(" "), fault)),
        node(tool & (get("tool.description") != ""), 5, "Fact", F.concat(F.lit("ToolSpec: "), label, F.lit(" | "), get("tool.description"))),
        node(tool & ~empty, 6, "Fact", F.concat(F.lit("ToolResult: "), result)),
        node(tool & ~empty & state["is_error"], 7, "Error", F.concat(F.lit("ToolResultError: "), why)),
    ]
    every = F.array_compact(F.array(*ruled))
    if "events" in spans.columns:
        happened = lambda e: F.concat_ws(" ", e["name"], e["attributes"])
        events = F.transform(F.coalesce("events", F.array()), lambda e, i: node(looks_like_error(happened(e)), i + 100, "Error", F.concat(F.lit("EventError: "), F.left(happened(e), F.lit(1000)))))
        every = F.concat(every, F.array_compact(events))
    if "logs" in spans.columns:
        done = lambda o: text.strip(F.coalesce(o, F.lit(""))).isin("", "<null>", "[]", "{}")
        logs = F.transform(F.coalesce("logs", F.array()), lambda x, i: F.array(
            node((F.coalesce(x["name"], F.lit("")) != "") & (x["name"] != "main"), i * 3 + 10_000, "Action", F.concat(F.lit("Function: "), x["name"], F.lit(" | Args: "), F.left(F.coalesce(x["arguments"], F.lit("")), F.lit(1200)))),
            node(~done(x["output"]), i * 3 + 10_001, "Fact", F.concat(F.lit("FunctionOutput: "), F.left(x["output"], F.lit(2200)))),
            node(~done(x["output"]) & validation.tool_status(status, x["output"])["is_error"], i * 3 + 10_002, "Error", F.concat(F.lit("FunctionError: "), F.left(x["output"], F.lit(1200)))),
        ))
        every = F.concat(every, F.array_compact(F.flatten(logs)))
    role = F.lower(get("chat.role"))
    other = F.coalesce(*[F.nullif(a[k], F.lit("")) for k in ("chat.content", "output.value", "llm.output_messages.0.message.content", "message.content")])
    kind = F.when(role == "assistant", F.when(final, "Conclusion").otherwise(output_type(other))).when(role == "system", "Planning").otherwise("Fact")
    plain = F.array_compact(F.array(node(other.isNotNull(), 1, kind, other)))
    rows = rows.withColumn("_all", F.when(F.size(every) > 0, every).otherwise(plain)).select("trace_id", "span_id", "parent_id", "pos", "ts", F.explode("_all").alias("x"))
    rows = rows.select("trace_id", "span_id", "parent_id", "pos", "ts", "x.rule", "x.type", text.shortened(F.col("x.content"), CONTENT).alias("content"))
    order = ["pos", "rule"]
    count = F.row_number().over(Window.partitionBy("trace_id", "type").orderBy(*order)) - 1
    return rows.select("trace_id", F.concat(F.left("type", F.lit(1)), F.lit("_"), count.cast("string")).alias("node_id"), F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)).alias("ord"), "type", "content", "span_id", "parent_id", "ts")
