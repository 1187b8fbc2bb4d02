"""Digests, judgements, reports and exports of graphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import json as js
from spanloom.functions import text
from spanloom.operators import graph

ARROWS = {"Cognitive": "-.->", "Call": "==>"}


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each trace, its graph as one JSON text (trace_id, graph): counts of all node types and of the edge types that occur, nodes in order, edges."""
    n = nodes.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("id"), "type", "content"))).alias("nodes"))
    e = edges.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type", "score"))).alias("edges"))
    both = n.join(e, "trace_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)))
    of_type = lambda t: F.size(F.filter("nodes", lambda x: x["type"] == t)).alias(t)
    kinds = F.struct(*[of_type(t) for t in graph.TYPES])
    found = F.array_sort(F.array_distinct(F.transform("edges", lambda x: x["edge_type"])))
    joins = F.map_from_arrays(found, F.transform(found, lambda t: F.size(F.filter("edges", lambda x: x["edge_type"] == t))))
    summary = F.struct(F.size("nodes").alias("total_nodes"), F.size("edges").alias("total_edges"), kinds.alias("node_types"), joins.alias("edge_types"))
    return both.select("trace_id", F.to_json(F.struct(summary.alias("summary"), "nodes", "edges")).alias("graph"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each trace, a Mermaid flow chart (trace_id, chart)."""
    label = F.regexp_replace(text.shortened(F.col("content"), 60), r'["\[\]\n|]', " ")
    node = F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit('["'), F.col("type"), F.lit(": "), label, F.lit('"]:::'), F.lower("type"))
    arrow = F.lit("-->")
    for k, v in ARROWS.items():
        arrow = F.when(F.col("edge_type") == k, v).otherwise(arrow)
    edge = F.concat(F.lit("  n"), F.col("source").cast("string"), F.lit(" "), arrow, F.lit("|"), F.col("edge_type"), F.lit("| n"), F.col("target").cast("string"))
    rows = nodes.select("trace_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), node.alias("line"))
    rows = rows.union(edges.select("trace_id", F.lit(1), F.col("source").cast("long"), F.col("target").cast("long"), edge))
    lines = rows.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select("trace_id", F.concat(F.lit("flowchart TD\n"), F.array_join("lines", "\n")).alias("chart"))


def digest(spans: DataFrame, most: int = 80, top: int = 20) -> DataFrame:
    """Of each trace: spans, errors, commonest tools with counts, repeated tools (4 times and more), and the first suspicious spans."""
    tools = spans.groupBy("trace_id", "tool").agg(F.count("*").alias("n"))
    ranked = tools.withColumn("r", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("n"), "tool")))
    listed = ranked.where(F.col("r") <= top).groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tool", "n"))), lambda x: F.concat(x["tool"], F.lit("="), x["n"].cast("string"))), ",").alias("tools"), F.count_if(F.col("n") >= 4).alias("repeated_tools"))
    suspicious = spans.where("status = 'Error'").withColumn("r", F.row_number().over(Window.partitionBy("trace_id").orderBy("pos"))).where(F.col("r") <= most)
    suspicious = suspicious.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "span_id"))), lambda x: x["span_id"].cast("string")), ",").alias("suspicious"))
    counts = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "Error").alias("errors"))
    return counts.join(listed, "trace_id", "left").join(suspicious, "trace_id", "left").withColumn("suspicious", F.coalesce("suspicious", F.lit("")))


def markdown_cell(value: Column) -> Column:
    """Text that is safe in a Markdown table."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\\", r"\\\\"), r"\|", r"\\|"), r"\r?\n", " ")


def markdown_report(findings: DataFrame) -> DataFrame:
    """Of each trace, its fault findings as a Markdown document (trace_id, report)."""
    row = F.concat(F.lit("| "), markdown_cell(F.col("fault_id")), F.lit(" | "), markdown_cell(F.col("name")), F.lit(" | "), F.format_number("confidence", 2), F.lit(" | "), F.col("n_evidence").cast("string"), F.lit(" |"))
    lines = findings.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fault_id", row.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("# Trace "), F.col("trace_id").cast("string"), F.lit("\n\n| fault | name | confidence | evidence |\n|---|---|---|---|\n"))
    return lines.select("trace_id", F.concat(head, F.array_join("lines", "\n"), F.lit("\n")).alias("report"))


def diagnostic_markdown(findings: DataFrame, causes: DataFrame, chains: DataFrame) -> DataFrame:
    """Of each trace, a diagnosis as a Markdown document (trace_id, report): severity, root causes, chains and rule findings, each where there are any.

    ``causes``: trace_id, place, location, reason, impact. ``chains``: trace_id, rank, path (array), score. ``findings`` as ``fault_findings`` gives them.
    """
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in IMPACT_RANK.items() for v in kv]), F.col("impact"))
    cell = markdown_cell
    table = lambda df, order, line, name: df.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias(name))
    key = lambda df: df.withColumn("trace_id", F.col("trace_id").cast("string"))
    worst = key(causes).groupBy("trace_id").agg(F.max_by("impact", rank).alias("severity"))
    one = table(key(causes), "place", F.concat(F.lit("| "), cell(F.col("location")), F.lit(" | "), cell(F.col("impact")), F.lit(" | "), cell(F.col("reason")), F.lit(" |")), "causes")
    two = table(key(chains), "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.array_join(F.col("path").cast("array<string>"), " -> "), F.lit(" ("), F.format_string("%.4f", "score"), F.lit(")")), "chains")
    three = table(key(findings), "fault_id", F.concat(F.lit("| "), cell(F.col("fault_id")), F.lit(" | "), cell(F.col("name")), F.lit(" | "), F.format_string("%.2f", "confidence"), F.lit(" |")), "rules")
    out = worst.join(one, "trace_id", "full").join(two, "trace_id", "full").join(three, "trace_id", "full")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit("\n")))
    body = F.concat_ws("", F.lit("# Diagnosis of trace "), F.col("trace_id"), F.lit("\n\n- severity: "), F.coalesce("severity", F.lit("unknown")), F.lit("\n"), part("\n## Root causes\n\n| location | impact | reason |\n|-|-|-|\n", "causes"), part("\n## Causal chains\n\n", "chains"), part("\n## Rule findings\n\n| fault | name | confidence |\n|-|-|-|\n", "rules"))
    return out.select("trace_id", body.alias("report"))


Judge = Callable[[str], str]


def offline_judge(prompt: str) -> str:
    """A judge without a model: names the first suspicious span of a digest as the root cause."""
    data = json.loads(prompt)
    first = (data.get("suspicious") or "").split(",")[0]
    causes = [{"location": first, "reason": "first failed span", "impact": "HIGH" if data.get("errors", 0) > 3 else "MEDIUM"}] if first else []
    return "```json\n" + json.dumps({"root_causes": causes, "errors": [], "scores": {"overall": 1.0 if not causes else 0.5}}) + "\n```"


def judged(digests: DataFrame, judge: Judge = offline_judge, tries: int = 3) -> DataFrame:
    """A judge's answers to digests (trace_id, ok, error, judgement JSON). A failing call is tried again; it fails its row alone."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for trace, prompt in zip(batch.column("trace_id").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                found, error = None, "no JSON in the answer"
                for _ in range(tries):
                    try:
                        found = js.lenient(judge(prompt))
                    except Exception as e:
                        error = str(e)[:200]
                    if found:
                        break
                rows.append((trace, found is not None, None if found else error, found))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.string(), pa.string()), strict=True)], names=["trace_id", "ok", "error", "judgement"])

    prompts = digests.select(F.col("trace_id").cast("string").alias("trace_id"), F.to_json(F.struct(*[c for c in digests.columns if c != "trace_id"])).alias("prompt"))
    return prompts.mapInArrow(ask, "trace_id string, ok boolean, error string, judgement string")


JUDGEMENT = "root_causes array<struct<location:string,reason:string,impact:string,module:string,confidence:double>>, errors array<struct<location:string,category:string,module:string>>, scores map<string,double>"
IMPACT_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


def root_cause_rows(judgements: DataFrame) -> DataFrame:
    """Root causes of judgements, a row each, with an impact of LOW, MEDIUM or HIGH (MEDIUM where it is another)."""
    x = judgements.where("ok").select("trace_id", F.from_json("judgement", JUDGEMENT).alias("j")).select("trace_id", F.posexplode("j.root_causes").alias("place", "c"))
    impact = F.upper(F.trim("c.impact"))
    return x.select("trace_id", "place", "c.location", "c.reason", F.when(impact.isin(*IMPACT_RANK), impact).otherwise("MEDIUM").alias("impact"))


def highest_impact(causes: DataFrame) -> DataFrame:
    """The highest impact of each trace."""
    rank = F.element_at(F.create_map(*[F.lit(v) for kv in IMPACT_RANK.items() for v in kv]), F.col("impact"))
    return causes.groupBy("trace_id").agg(F.max_by("impact", rank).alias("impact"))


def still_to_do(traces: DataFrame, done: DataFrame) -> DataFrame:
    """Traces without a result yet: how a batch goes on."""
    return traces.join(done.select("trace_id").distinct(), "trace_id", "left_anti")
