"""Semantic validation of traces: who used which tool result, what is wrong with calls, and whether it reaches the final answer.

The steps of a trace are its spans in the order of their time, as ``steps`` makes them from canonical spans. Links go
from a tool call to the model calls that were shown its result. All joins are on the trace and a key in it; only the
search for what an argument came from compares all earlier outputs of its trace.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import json as js
from spanloom.functions import text
from spanloom.lineage import checkpointed
from spanloom.operators import spans as tree
from spanloom.operators import validation

# Words by which a model says that it set a result aside.
IGNORE_TERMS = r"(?:不可靠|忽略|未采用|不采用|不使用|无关|过期|discard|unreliable|outdated|doesn['’]t\s+match|ignored|not\s+used)"
# Fields that a call and its result should agree on.
COMPARABLE = ("entity", "location", "city", "resource_id", "document_id", "user_id")
#: Characters of earlier results that an argument may come from.
EVIDENCE_ROOM = 30_000


def is_model(name: Column, attributes: Column) -> Column:
    """Whether a span is a call of a language model."""
    return F.coalesce(attributes["otel.original_span_name"] == "gen_ai.chat", F.lit(False)) | F.coalesce(name == "LiteLLMModel.__call__", F.lit(False))


def is_tool(attributes: Column) -> Column:
    """Whether a span is a call of a tool."""
    return F.coalesce(attributes["tool.name"], F.lit("")) != ""


def is_agent_run(name: Column) -> Column:
    """Whether a span is the run of an agent."""
    return F.coalesce(F.lower(name).rlike(r"agent\.run$"), F.lit(False))


def steps(spans: DataFrame) -> DataFrame:
    """Canonical spans (trace_id, span_id, parent_id, ts, pos, name, status, attributes) as steps with ``seq``, their place by time.

    ``output`` is what a model said: its first output message, else its assistant messages, else the plain output value.
    ``shown`` are the ids of tool calls whose results a model was given. Nulls count as empty texts.
    """
    a = F.col("attributes")
    blank = lambda c: F.coalesce(c, F.lit(""))
    said = F.array_join(F.transform(F.filter(js.messages(a["gen_ai.output.messages"]), lambda m: m["role"] == "assistant"), js.message_text), "\n")
    direct = a["llm.output_messages.0.message.content"]
    output = F.when(text.strip(blank(direct)) != "", direct).when(text.strip(blank(said)) != "", said).otherwise(blank(a["output.value"]))
    given = F.filter(js.messages(a["gen_ai.input.messages"]), lambda m: (m["role"] == "tool") & (blank(m["tool_call_id"]) != ""))
    asks = F.exists(js.messages(a["gen_ai.output.messages"]), lambda m: F.size(F.coalesce(m["tool_calls"], F.array().cast("array<string>"))) > 0)
    rows = spans.select(
        "trace_id", "span_id", F.col("parent_id"), blank(F.col("ts").cast("string")).alias("ts"), "pos", F.col("name"), blank(F.col("status")).alias("status"),
        is_tool(a).alias("is_tool"), is_model(F.col("name"), a).alias("is_model"), blank(a["tool.name"]).alias("tool"), blank(a["tool.id"]).alias("tool_id"), a["tool.parameters"].alias("schema"),
        blank(a["input.value"]).alias("arguments"), blank(a["output.value"]).alias("result"), output.alias("output"), blank(a["gen_ai.output.messages"]).alias("raw_output"),
        F.array_distinct(F.transform(F.coalesce(given, F.array().cast(js.MESSAGES)), lambda m: m["tool_call_id"])).alias("shown"), F.coalesce(asks, F.lit(False)).alias("asks_tools"),
    )
    return tree.in_order(rows)


def url_of(arguments: Column) -> Column:
    """The URL among a call's arguments: its ``url`` field, else the first in the text; empty if none."""
    field = F.get_json_object(arguments, "$.url")
    return F.coalesce(field, F.regexp_extract(arguments, r"https?://[^\s'\"}]+", 0), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-cased authority of a URL without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))), r"^www\.", "")


def quoted(word: Column) -> Column:
    """A pattern that a text matches literally."""
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def set_aside(word: Column, within: Column, reach: int) -> Column:
    """Whether the word and an ignore term stand within ``reach`` characters of each other."""
    gap = F.lit(f".{{0,{reach}}}")
    return F.rlike(within, F.concat(F.lit("(?is)(?:"), quoted(word), gap, F.lit(IGNORE_TERMS + "|" + IGNORE_TERMS), gap, quoted(word), F.lit(")")))


def squeezed(t: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(t, r"\s+", "")


def candidates(rows: DataFrame) -> DataFrame:
    """Tool calls with the model calls that may have used their result (trace_id, source, consumer, method).

    Those whose input names the call's id, whatever their order; where there is none, later ones under the same parent.
    """
    tools = rows.where("is_tool").select("trace_id", F.col("span_id").alias("source"), "tool_id", F.col("seq").alias("at"), F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("branch"))
    models = rows.where("is_model").select("trace_id", F.col("span_id").alias("consumer"), "shown", F.col("seq").alias("then"), F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("branch"))
    named = tools.where("tool_id != ''").join(models.select("trace_id", "consumer", F.explode("shown").alias("tool_id")), ["trace_id", "tool_id"]).select("trace_id", "source", "consumer", F.lit("tool_call_id").alias("method"))
    rest = tools.join(named.select("trace_id", "source").distinct(), ["trace_id", "source"], "left_anti")
    later = rest.join(models.drop("shown"), ["trace_id", "branch"]).where("then > at").select("trace_id", "source", "consumer", F.lit("same_branch_order").alias("method"))
    return named.unionByName(later)


def delivery_links(rows: DataFrame) -> DataFrame:
    """Links (trace_id, source, consumer, tool_id, method, state, matched, confidence, relation) of tool results to the model calls that were shown them.

    REJECTED where the model sets the result aside, PROPAGATED with three matching signatures, and for a named call
    TRANSFORMED with one and EXPOSED with none. Order alone proves neither use nor neglect, so such links are left out.
    """
    pairs = candidates(rows)
    results = rows.where("is_tool").select("trace_id", F.col("span_id").alias("source"), "tool_id", text.fact_signatures(F.col("result")).alias("facts"), host_of(url_of(F.col("arguments"))).alias("host"))
    said = rows.where("is_model").select("trace_id", F.col("span_id").alias("consumer"), "output", squeezed(F.col("output")).alias("dense")).where(text.strip(F.col("output")) != "")
    both = pairs.join(results, ["trace_id", "source"]).join(said, ["trace_id", "consumer"])
    both = both.withColumn("overlap", F.array_sort(F.filter("facts", lambda s: F.contains(F.col("dense"), s))))
    near_fact = F.exists(F.slice("overlap", 1, 12), lambda s: set_aside(s, F.col("dense"), 100))
    both = both.withColumn("ignored", F.when(F.col("host") != "", set_aside(F.col("host"), F.col("output"), 160)).otherwise(near_fact)).withColumn("n", F.size("overlap"))
    named = F.col("method") == "tool_call_id"
    both = both.withColumn("state", F.when(F.col("ignored"), "REJECTED").when(F.col("n") >= 3, "PROPAGATED").when(named & (F.col("n") >= 1), "TRANSFORMED").when(named, "EXPOSED")).where("state is not null")
    base = F.least(F.lit(1.0), 0.45 + 0.1 * F.col("n"))
    confidence = F.when(named, F.greatest(base, F.when(F.col("state").isin("EXPOSED", "REJECTED"), 0.9).otherwise(0.95))).when(F.col("state") == "PROPAGATED", F.least(base, F.lit(0.82))).otherwise(base)
    relation = F.when(F.col("state") == "REJECTED", "ignored").when(F.col("state") == "EXPOSED", "exposed").otherwise("consumed")
    return both.select("trace_id", "source", "consumer", F.nullif("tool_id", F.lit("")).alias("tool_id"), "method", "state", F.slice("overlap", 1, 12).alias("matched"), F.round(confidence, 2).alias("confidence"), relation.alias("relation"))


def subagent_returns(rows: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """A link from the latest model call below a tool call to that call, if its result holds what the model said. ``closure``: all ancestors, if known."""
    closure = tree.ancestors(rows.select("trace_id", "span_id", "parent_id")) if closure is None else closure
    wrappers = rows.where("is_tool and result != ''").select("trace_id", F.col("span_id").alias("ancestor_id"), "result", "tool_id", squeezed(F.col("result")).alias("dense"))
    models = rows.where("is_model").select("trace_id", "span_id", "output", "ts", "seq", text.fact_signatures(F.col("output")).alias("facts"))
    both = closure.join(wrappers, ["trace_id", "ancestor_id"]).join(models, ["trace_id", "span_id"])
    both = both.withColumn("overlap", F.array_sort(F.filter("facts", lambda s: F.contains(F.col("dense"), s)))).where((F.size("overlap") >= 3) | F.contains("result", text.strip(F.col("output"))))
    best = both.groupBy("trace_id", "ancestor_id").agg(F.max_by(F.struct("span_id", "overlap", "tool_id"), F.struct("ts", -F.col("seq"))).alias("b"))
    return best.select("trace_id", F.col("b.span_id").alias("source"), F.col("ancestor_id").alias("consumer"), F.nullif("b.tool_id", F.lit("")).alias("tool_id"), F.lit("subagent_return").alias("method"), F.lit("PROPAGATED").alias("state"), F.slice("b.overlap", 1, 12).alias("matched"), F.lit(0.96).alias("confidence"), F.lit("consumed").alias("relation"))


def final_answers(rows: DataFrame) -> DataFrame:
    """The final answer of each trace that has one: the latest model output without tool calls, outside all tool calls if there is such."""
    said = rows.where(F.col("is_model") & ~F.col("asks_tools") & (text.strip(F.col("output")) != "")).select("trace_id", "span_id", "ts", "seq")
    inside = tree.nearest_ancestor(rows, F.when(F.col("is_tool"), "tool"), "above").select("trace_id", "span_id", "above")
    marked = said.join(inside, ["trace_id", "span_id"], "left")
    return marked.groupBy("trace_id").agg(F.max_by("span_id", F.struct(F.col("above").isNull(), "ts", -F.col("seq"))).alias("final_id"))


def origins(rows: DataFrame) -> DataFrame:
    """For each tool call the latest earlier span whose raw output holds the call's id or its arguments (trace_id, span_id, origin_id).

    Outputs are searched as JSON writes them, with quotes escaped. Every call is held against all earlier outputs of its trace.
    """
    calls = rows.where("is_tool and (tool_id != '' or arguments != '')").select("trace_id", "span_id", "tool_id", "arguments", F.col("seq").alias("at"))
    texts = rows.where("raw_output != ''").select("trace_id", F.col("span_id").alias("origin_id"), "seq", F.to_json(F.array("raw_output")).alias("hay"))
    holds = lambda c: (F.col(c) != "") & F.contains("hay", F.col(c))
    found = calls.join(texts, "trace_id").where((F.col("seq") < F.col("at")) & (holds("tool_id") | holds("arguments")))
    return found.groupBy("trace_id", "span_id").agg(F.max_by("origin_id", "seq").alias("origin_id"))


def prior_evidence(rows: DataFrame, room: int = EVIDENCE_ROOM, closure: DataFrame | None = None) -> DataFrame:
    """For each tool call the results of earlier tool calls of its trace that aren't above it, the last ``room`` characters (trace_id, span_id, evidence).

    A call meets only the results that can stand within its room: running lengths are cut into blocks of the room's size, and
    it looks at its own block, the three before, and as many more as the results above it take.
    """
    tools = rows.where("is_tool").select("trace_id", "span_id", "seq", F.right("result", F.lit(room)).alias("result"))
    w = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("result") != "", F.length("result") + 1).otherwise(0).cast("long")
    tools = tools.withColumn("size", size).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    held = tools.where("size > 0")
    closure = tree.ancestors(rows.select("trace_id", "span_id", "parent_id")) if closure is None else closure
    above = closure.join(held.select("trace_id", F.col("span_id").alias("ancestor_id"), "size"), ["trace_id", "ancestor_id"])
    taken = above.groupBy("trace_id", "span_id").agg(F.sum("size").alias("skipped"))
    calls = tools.select("trace_id", "span_id", F.col("seq").alias("at"), F.col("before").alias("upto")).join(taken, ["trace_id", "span_id"], "left")
    block = lambda c: F.floor(c / room)
    lowest = F.greatest(F.lit(0), block(F.col("upto") - 2 * room - F.coalesce("skipped", F.lit(0)) - 2))
    asks = calls.where("upto > 0").select("*", F.explode(F.sequence(lowest, block(F.col("upto")))).alias("block"))
    parts = held.select("trace_id", F.col("span_id").alias("ancestor_id"), "seq", "result", block(F.col("before")).alias("block"))
    met = asks.join(parts, ["trace_id", "block"]).where("seq < at").join(above.select("trace_id", "span_id", "ancestor_id"), ["trace_id", "span_id", "ancestor_id"], "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "result"))), lambda x: x["result"]), "\n")
    return met.groupBy("trace_id", "span_id").agg(F.right(joined, F.lit(room)).alias("evidence"))


REPORT = "state string, reaches_final boolean, path array<string>, confidence double"


def report(source: str, links: dict[str, list[dict]], finals: set[str]) -> tuple[str, bool, list[str], float]:
    """How what a span gave travels on: breadth first over links that were used, to the first final answer."""
    queue, seen = deque([((source,), 1.0)]), {source}
    while queue:
        path, sure = queue.popleft()
        if path[-1] in finals:
            return "PROPAGATED", True, list(path), round(sure, 4)
        for k in links.get(path[-1], ()):
            if k["state"] in ("PROPAGATED", "TRANSFORMED") and k["consumer"] not in seen:
                seen.add(k["consumer"])
                queue.append(((*path, k["consumer"]), min(sure, k["confidence"])))
    own = links.get(source, [])
    states = {k["state"] for k in own}
    for name, like in (("REJECTED", {"REJECTED"}), ("EXPOSED", {"EXPOSED"}), ("PROPAGATED", {"PROPAGATED", "TRANSFORMED"}), ("UNKNOWN", states)):
        if states & like:
            return name, False, [], max(k["confidence"] for k in own)
    return "NOT_EXPOSED", False, [], 1.0


def propagation(links: DataFrame, finals: DataFrame, sources: DataFrame) -> DataFrame:
    """REPORT of each source (trace_id, source) from the links of its trace and its final answer (trace_id, final_id).

    A trace's links meet in one row without their texts: two ids, a state and a number each, in the order of source, consumer.
    """
    kind = dict(sources.dtypes)["source"]
    ends = links.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), F.col("consumer").cast("string").alias("consumer"), "state", "confidence"))).alias("links"))
    goals = finals.groupBy("trace_id").agg(F.collect_set(F.col("final_id").cast("string")).alias("finals"))
    asked = sources.groupBy("trace_id").agg(F.collect_set(F.col("source").cast("string")).alias("sources"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.select(["links", "finals", "sources"]).to_pylist():
                by: dict[str, list[dict]] = {}
                for k in r["links"] or ():
                    by.setdefault(k["source"], []).append(k)
                goals = set(r["finals"] or ())
                found.append([dict(zip(("source", "state", "reaches_final", "path", "confidence"), (s, *report(s, by, goals)), strict=True)) for s in sorted(r["sources"])])
            shape = pa.list_(pa.struct([("source", pa.string()), ("state", pa.string()), ("reaches_final", pa.bool_()), ("path", pa.list_(pa.string())), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("trace_id"), pa.array(found, shape)], names=["trace_id", "found"])

    trace = dict(sources.dtypes)["trace_id"]
    rows = asked.join(ends, "trace_id", "left").join(goals, "trace_id", "left").mapInArrow(work, f"trace_id {trace}, found array<struct<source:string,state:string,reaches_final:boolean,path:array<string>,confidence:double>>")
    return rows.select("trace_id", F.explode("found").alias("f")).select("trace_id", F.col("f.source").cast(kind).alias("source"), "f.state", "f.reaches_final", "f.path", "f.confidence")


Rule = Callable[[DataFrame], DataFrame]


def call_violations(rows: DataFrame, links: DataFrame, rules: tuple[Rule, ...] = (), closure: DataFrame | None = None) -> DataFrame:
    """Violations of the tool calls among the steps: trace_id, span_id, violation_type, dimension, severity, confidence.

    ``rules`` are further functions of the calls (the steps with task, evidence, consumed) that return rows of the same columns.
    """
    used = links.where("state in ('PROPAGATED', 'TRANSFORMED')").select("trace_id", F.col("source").alias("span_id")).distinct().withColumn("consumed", F.lit(True))
    task = tree.nearest_ancestor(rows, F.col("arguments"), "task").select("trace_id", "span_id", "task")
    calls = rows.where("is_tool").join(used, ["trace_id", "span_id"], "left").join(task, ["trace_id", "span_id"], "left").join(prior_evidence(rows, closure=closure), ["trace_id", "span_id"], "left")
    calls = calls.withColumn("consumed", F.coalesce("consumed", F.lit(False))).withColumn("task", F.coalesce("task", F.lit(""))).withColumn("evidence", F.coalesce("evidence", F.lit("")))
    status = validation.tool_status(F.col("status"), F.col("result"))
    need = F.from_json(F.get_json_object("schema", "$.required"), "array<string>")
    absent = F.array_except(F.coalesce(need, F.array().cast("array<string>")), F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")))
    http = F.regexp_extract("result", r"(?im)^Status:\s*(\d{3})\b", 1).try_cast("int")
    asked = F.get(text.dates(F.col("task")), F.lit(0))
    day = F.col("asked").try_cast("date")
    spelt = F.array(F.col("asked"), F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.day(day), F.lit("日")), F.concat(F.month(day), F.lit("月"), F.day(day), F.lit("日")))
    calls = calls.withColumn("asked", asked)
    other_day = day.isNotNull() & (F.size(text.dates(F.col("result"))) > 0) & ~F.exists(spelt, lambda s: F.contains(F.col("result"), s))
    loose = F.filter(text.opaque_arguments(F.col("arguments"), url_of(F.col("arguments"))), lambda t: ~F.contains(F.col("task"), t) & ~F.contains(F.col("evidence"), t))
    terms = text.task_terms(F.col("task"))
    echoed = (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.col("result"), t))
    row = lambda when, name, dim, severity, sure: F.when(when, F.struct(F.lit(name).alias("violation_type"), dim.alias("dimension"), severity.alias("severity"), sure.alias("confidence")))
    lit = F.lit
    differ = F.transform(F.filter(F.array(*[lit(k) for k in COMPARABLE]), lambda k: validation.fields_differ(F.col("arguments"), F.col("result"), k)), lambda k: F.struct(lit("argument_result_mismatch").alias("violation_type"), k.alias("dimension"), lit("HIGH").alias("severity"), lit(0.99).alias("confidence")))
    one = F.array_compact(F.array(
        row(F.size(absent) > 0, "missing_required_argument", lit("argument_schema"), lit("HIGH"), lit(1.0)),
        row(status["is_error"], "tool_execution_failure", lit("execution_status"), lit("HIGH"), lit(1.0)),
        row(~status["is_error"] & (F.col("result") == ""), "empty_tool_result", lit("result_presence"), lit("MEDIUM"), lit(1.0)),
        row(http >= 400, "http_failure", lit("http_status"), lit("HIGH"), lit(1.0)),
        row(other_day, "temporal_mismatch", lit("date"), F.when(F.col("consumed"), "HIGH").otherwise("MEDIUM"), lit(0.96)),
        row(F.size(loose) > 0, "ungrounded_tool_argument", lit("argument_provenance"), F.when(F.col("consumed") & ~echoed, "HIGH").otherwise("MEDIUM"), F.when(echoed, 0.78).otherwise(0.94)),
    ))
    out = calls.select("trace_id", "span_id", F.explode(F.concat(one, differ)).alias("v")).select("trace_id", "span_id", "v.*")
    for rule in rules:
        out = out.unionByName(rule(calls).select(*out.columns))
    return out


def validate(rows: DataFrame, rules: tuple[Rule, ...] = ()) -> dict[str, DataFrame]:
    """All results of semantic validation of the steps: checks, violations, links, propagation and final answers.

    ``checks`` has a row for each tool call with its verdict: invalid with any violation, uncertain with an ungrounded argument.
    """
    rows = checkpointed(rows)
    closure = tree.ancestors(rows.select("trace_id", "span_id", "parent_id"))
    links = checkpointed(delivery_links(rows))
    found = checkpointed(call_violations(rows, links, rules, closure))
    every = links.unionByName(subagent_returns(rows, closure))
    finals = checkpointed(final_answers(rows))
    reach = checkpointed(propagation(every, finals, found.select("trace_id", F.col("span_id").alias("source")).distinct()))
    named = reach.withColumnRenamed("source", "span_id").withColumnRenamed("confidence", "probability")
    violations = found.join(named, ["trace_id", "span_id"]).withColumn("probability", F.when(F.col("reaches_final"), F.col("probability")).otherwise(0.0))
    used = links.where("state in ('PROPAGATED', 'TRANSFORMED')").groupBy("trace_id", F.col("source").alias("span_id")).agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))
    kinds = found.groupBy("trace_id", "span_id").agg(F.array_sort(F.collect_list("violation_type")).alias("violation_types"))
    calls = rows.where("is_tool").select("trace_id", "span_id", "tool", F.left("arguments", F.lit(1200)).alias("arguments"), F.left("result", F.lit(1600)).alias("result_preview"))
    calls = calls.join(used, ["trace_id", "span_id"], "left").join(kinds, ["trace_id", "span_id"], "left").join(named.select("trace_id", "span_id", "state", "reaches_final"), ["trace_id", "span_id"], "left").join(origins(rows), ["trace_id", "span_id"], "left")
    verdict = F.when(F.col("violation_types").isNull(), "valid").when(F.array_contains("violation_types", "ungrounded_tool_argument"), "uncertain").otherwise("invalid")
    checks = calls.select("trace_id", "span_id", "tool", "arguments", "result_preview", "origin_id", F.coalesce("consumers", F.array().cast(dict(used.dtypes)["consumers"])).alias("consumers"), F.col("consumers").isNotNull().alias("consumed"), verdict.alias("verdict"), F.coalesce("violation_types", F.array().cast("array<string>")).alias("violation_types"), F.coalesce("state", F.lit("NOT_EXPOSED")).alias("propagation_state"), F.coalesce("reaches_final", F.lit(False)).alias("reaches_final"))
    return {"checks": checks, "violations": violations, "links": every, "propagation": reach, "finals": finals}


def rule_findings(violations: DataFrame, checks: DataFrame) -> DataFrame:
    """Fault findings that follow from validation (trace_id, fault_id, confidence, n_evidence, requires_review): calls that crash, break their contract, cannot be traced, miss the date, or go unused."""
    of = {"F4": (("tool_execution_failure", "http_failure"), 0.98, False), "F9": (("missing_required_argument", "argument_result_mismatch"), 0.97, False), "F9-U": (("ungrounded_tool_argument",), 0.82, True), "F1/F6": (("temporal_mismatch",), 0.88, True)}
    fault = F.lit(None).cast("string")
    for k, (kinds, _, _) in of.items():
        fault = F.when(F.col("violation_type").isin(*kinds), k).otherwise(fault)
    rows = violations.select("trace_id", "span_id", fault.alias("fault_id")).where("fault_id is not null")
    idle = checks.where("result_preview != '' and not consumed").select("trace_id", "span_id", F.lit("F6-candidate").alias("fault_id"))
    counts = rows.unionByName(idle).groupBy("trace_id", "fault_id").agg(F.count_distinct("span_id").alias("n_evidence"))
    sure, review = F.lit(0.55), F.lit(True)
    for k, (_, c, r) in of.items():
        sure, review = F.when(F.col("fault_id") == k, c).otherwise(sure), F.when(F.col("fault_id") == k, r).otherwise(review)
    return counts.select("trace_id", "fault_id", sure.alias("confidence"), "n_evidence", review.alias("requires_review"))
