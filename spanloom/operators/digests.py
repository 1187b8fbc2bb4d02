"""What a judge or a reader is given of a graph, and where what the judge says is put: digests, signals, packs, reports, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import graph
from spanloom.operators.reports import markdown_cell

# Words of failed observations and of results that are mostly noise.
FAILED = ("error", "exception", "failed", "timeout")
NOISE = ("google", "search results", "web results", "reddit", "github", "viewport position")
# Node types by the prefix of their ids.
PREFIX = {"I": "Intent", "P": "Planning", "A": "Action", "F": "Fact", "E": "Error", "C": "Conclusion"}


def _any(t: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def type_of_id(node: Column) -> Column:
    """The type that an id such as F_12 tells; unknown for others."""
    out = F.lit("unknown")
    for k, v in PREFIX.items():
        out = F.when(node.rlike(rf"^{k}_\d+$"), v).otherwise(out)
    return out


def input_mode(trace_id: Column, default: str, full: Column) -> Column:
    """``full`` for traces that the list of ids names, else the default."""
    return F.when(F.array_contains(full, trace_id.cast("string")), "full").otherwise(default)


def signals(nodes: DataFrame, edges: DataFrame, least: float = 4.0) -> DataFrame:
    """Of each trace, what its graph shows of unsupported conclusions, loops, crashes, unused facts and noise.

    Nodes have saliency. Returns trace_id, conclusions, fact_support (edges from facts to conclusions), no_fact_support, retry_edges,
    observation_edges, failed_observations, isolated_facts (salient facts without a cognitive edge), noise_support.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    end = lambda side: nodes.select("trace_id", F.col("node_id").alias(side), F.col("type").alias(f"{side}_type"), _any(low, FAILED).alias(f"{side}_failed"), _any(low, NOISE).alias(f"{side}_noise"))
    rows = edges.join(end("source"), ["trace_id", "source"], "left").join(end("target"), ["trace_id", "target"], "left")
    thought = F.col("edge_type") == "Cognitive"
    support = thought & (F.col("source_type") == "Fact") & (F.col("target_type") == "Conclusion")
    failed = (F.col("edge_type") == "Observation") & (F.col("source_type") == "Action") & F.col("target_type").isin("Error", "Fact") & F.col("target_failed")
    e = rows.groupBy("trace_id").agg(
        F.count_if(support).alias("fact_support"), F.count_if(F.col("edge_type") == "Retry").alias("retry_edges"), F.count_if(F.col("edge_type") == "Observation").alias("observation_edges"), F.count_if(failed).alias("failed_observations"), F.count_if(support & F.col("source_noise")).alias("noise_support")
    )
    used = edges.where(thought).select("trace_id", F.col("source").alias("node_id")).distinct().withColumn("_used", F.lit(True))
    n = nodes.join(used, ["trace_id", "node_id"], "left").groupBy("trace_id").agg(F.count_if(F.col("type") == "Conclusion").alias("conclusions"), F.count_if((F.col("type") == "Fact") & F.col("_used").isNull() & (F.col("saliency") >= least)).alias("isolated_facts"))
    out = n.join(e, "trace_id", "left").na.fill(0)
    return out.select("trace_id", "conclusions", "fact_support", ((F.col("conclusions") > 0) & (F.col("fact_support") == 0)).alias("no_fact_support"), "retry_edges", "observation_edges", "failed_observations", "isolated_facts", "noise_support")


def projected(nodes: DataFrame, edges: DataFrame, mode: str = "hybrid", most: int = 30) -> DataFrame:
    """The most salient nodes of each trace with their degrees and, by mode, a short text (hybrid) or only its size and flags (pure)."""
    if mode not in ("hybrid", "pure"):
        raise ValueError(f"unknown mode {mode!r}; known: hybrid, pure")
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("saliency"), "ord"))).where(F.col("rank") <= most)
    out = ranked.join(graph.degrees(edges), ["trace_id", "node_id"], "left").na.fill(0, ["in_degree", "out_degree"])
    base = ["trace_id", "rank", "node_id", "type", "saliency", "in_degree", "out_degree"]
    if mode == "hybrid":
        return out.select(*base, F.left("content", F.lit(220)).alias("display"))
    flags = text.content_flags(F.col("content"))
    return out.select(*base, F.length("content").alias("content_chars"), F.array_compact(F.array(*[F.when(c, k) for k, c in flags.items()])).alias("content_flags"))


def format_violations(nodes: DataFrame, most: int = 20) -> DataFrame:
    """Error nodes that name a missing tag, the first of each trace, with the tags."""
    rows = nodes.where((F.col("type") == "Error") & F.col("content").startswith("FormattingError: missing required tag"))
    w = Window.partitionBy("trace_id").orderBy("ord")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("trace_id", "node_id", "place", F.regexp_extract_all("content", F.lit(r"<[^>\s]+>"), 0).alias("required_tags"), F.left("content", F.lit(220)).alias("evidence"))


def graph_digest(nodes: DataFrame, edges: DataFrame, mode: str = "hybrid", cognitive: int = 40) -> DataFrame:
    """Of each trace, one JSON text for a judge (trace_id, digest): counts by type, salient nodes, best cognitive edges, signals and missing tags."""
    top = projected(nodes, edges, mode)
    top = top.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in top.columns if c not in ("trace_id", "rank")]))).alias("top_salient_nodes"))
    best = edges.where("edge_type = 'Cognitive'").withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), "source", "target"))).where(F.col("rank") <= cognitive)
    best = best.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "target", "score"))).alias("top_cognitive_edges"))
    found = signals(nodes, edges)
    found = found.select("trace_id", F.struct(*[c for c in found.columns if c != "trace_id"]).alias("signals"))
    tags = format_violations(nodes).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "required_tags", "evidence"))).alias("format_violations"))
    out = graph.summary(nodes, edges)
    out = out.select("trace_id", F.struct(*[c for c in out.columns if c != "trace_id"]).alias("stats"))
    for part in (top, best, found, tags):
        out = out.join(part, "trace_id", "left")
    return out.select("trace_id", F.to_json(F.struct(F.lit(mode).alias("representation_mode"), *[c for c in out.columns if c != "trace_id"])).alias("digest"))


def compact_chains(ranked: DataFrame, nodes: DataFrame, mode: str = "hybrid", most: int = 8) -> DataFrame:
    """The first chains of each trace (trace_id, rank, node_id, usage, target, path, score) with the evidence of their three main nodes, or its size."""
    out = ranked.where(F.col("rank") <= most)
    for role, key in (("origin", "node_id"), ("usage", "usage"), ("final", "target")):
        t = F.coalesce("content", F.lit(""))
        said = F.left(t, F.lit(180)).alias(f"{role}_evidence") if mode == "hybrid" else F.least(F.length(t), F.lit(180)).alias(f"{role}_evidence_chars")
        out = out.join(nodes.select("trace_id", F.col("node_id").alias(key), F.col("type").alias(f"{role}_type"), said), ["trace_id", key], "left")
    return out


# --- where a root cause is put

# Words of the fields of a chain and a root cause that decide where people would put it.
FORMAT_TERMS = ("format", "formatting", "missing required tag", "schema", "syntax", "parse", "invalid json", "typeerror", "code execution failed")
FINAL_TERMS = ("completion failure", "did not provide the final answer", "failed to provide the final answer", "missing final answer", "no final answer", "stops on the tool call")
RETRY_TERMS = ("retry", "again", "repeated", "resource abuse", "loop")
EVIDENCE_TERMS = ("retrieval", "search", "evidence", "observation", "result", "misinterpret")
CLAIM_TERMS = ("unsupported", "hallucinat", "language-only", "claim", "reasoning")
STATE_TERMS = ("upstream", "setup", "configured", "configuration", "config", "stored", "wrote", "written", "bad path", "bad state", "bad value", "bad artifact", "invalid value", "nonexistent", "unsupported model", "negative timeout", "missing key", "schema key")
EVIDENCE_TYPES = ("wrong_evidence_used", "wrong_or_low_quality_evidence_used", "crucial_fact_ignored", "tool_output_misinterpretation")
CLAIM_TYPES = ("unsupported_or_invalid_reasoning", "agent_trace_failure", "instruction_violation", "context_memory_failure")

ROLES = ("origin", "root", "usage", "final")


def placed_chains(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chains (trace_id, chain, origin, root, usage, final, path of node ids) with ``on``: their nodes in the order of the path, then by role.

    Each has its node, location (the node's span, lower-cased, else the node itself), type and role. ``nodes`` gives the spans.
    """
    named = F.array_compact(F.concat(F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda p: F.struct(p.alias("node"))), F.array(*[F.struct(F.col(r).alias("node")) for r in ROLES])))
    rows = chains.select("trace_id", "chain", *ROLES, F.posexplode(named).alias("at", "x")).select("trace_id", "chain", *ROLES, "at", F.trim("x.node").alias("node")).where("node != '' and node != 'unknown'")
    rows = rows.groupBy("trace_id", "chain", "node", *ROLES).agg(F.min("at").alias("at"))
    role = F.lit("path")
    for r in reversed(ROLES):
        role = F.when(F.col("node") == F.col(r), r).otherwise(role)
    spans = nodes.select("trace_id", F.col("node_id").cast("string").alias("node"), F.lower(F.col("span_id").cast("string")).alias("_span"))
    rows = rows.withColumn("role", role).join(spans, ["trace_id", "node"], "left")
    place = F.when(F.col("node").rlike("^[0-9a-fA-F]{16}$"), F.lower("node")).otherwise(F.coalesce("_span", "node"))
    on = rows.groupBy("trace_id", "chain").agg(F.array_sort(F.collect_list(F.struct("at", "node", place.alias("location"), type_of_id(F.col("node")).alias("type"), "role"))).alias("on"))
    return chains.join(on, ["trace_id", "chain"], "left")


def anchor(on: Column, cause: Column, said: Column) -> Column:
    """Of a chain's nodes, the one where people would put a root cause of this type and text: struct of node, location, rule."""
    low, kind = F.lower(F.coalesce(said, F.lit(""))), F.lower(F.coalesce(cause, F.lit("")))
    first = lambda when: F.get(F.filter(on, when), F.lit(0))
    of = lambda *types: first(lambda x: x["type"].isin(*types))
    role = lambda r: first(lambda x: x["role"] == r)
    origin, usage, final = F.coalesce(role("origin"), role("root")), role("usage"), role("final")
    error, action, thought, plan, fact = of("Error"), of("Action"), of("Planning", "Conclusion"), of("Planning"), of("Fact")
    fallback = F.coalesce(origin, usage, final, F.get(on, F.lit(0)))
    pick = lambda rule, *ways: F.struct(F.coalesce(*ways, fallback).alias("x"), F.lit(rule).alias("rule"))
    ladder = (
        F.when(_any(low, STATE_TERMS) & F.coalesce(origin, action).isNotNull(), pick("upstream_root_action", origin, action))
        .when(kind.isin("final_answer_symptom", "final_answer_or_completion_failure") | _any(low, FINAL_TERMS), pick("final_symptom", final, of("Conclusion", "Action")))
        .when(kind == "tool_or_execution_failure", pick("first_visible_error", error, fact, origin))
        .when((kind == "format_or_tool_argument_error") & _any(low, FORMAT_TERMS) & error.isNotNull(), pick("first_visible_error", error))
        .when((kind == "format_or_tool_argument_error") & action.isNotNull(), pick("bad_action_call", action))
        .when(kind == "format_or_tool_argument_error", F.when(error.isNotNull(), pick("first_visible_error", error)).otherwise(pick("earliest_origin", origin)))
        .when(kind == "wrong_action_or_tool_choice", F.when(action.isNotNull(), pick("bad_action_call", action)).otherwise(pick("earliest_origin", plan, origin)))
        .when((kind == "retry_or_recovery_failure") | _any(low, RETRY_TERMS), F.when(action.isNotNull(), pick("bad_action_call", action)).otherwise(pick("first_visible_error", error, usage, origin)))
        .when(kind.isin(*EVIDENCE_TYPES) | _any(low, EVIDENCE_TERMS), pick("evidence", thought, action, fact, usage, origin))
        .when(kind.isin(*CLAIM_TYPES) | _any(low, CLAIM_TERMS), pick("earliest_origin", thought, origin, usage))
        .otherwise(pick("earliest_origin", fallback))
    )
    rule = F.when(ladder["rule"] == "evidence", F.when(ladder["x"] == usage, "unsupported_usage").otherwise("earliest_origin")).otherwise(ladder["rule"])
    return F.struct(ladder["x"]["node"].alias("node"), ladder["x"]["location"].alias("location"), rule.alias("rule"))


def relocated(causes: DataFrame, chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """Root causes (trace_id, item, location, said) moved to the anchor of the first chain that holds their location; a lone one to that of the first chain.

    Chains have cause_type and said as well. Returns trace_id, item, original_location, location, rule, moved; causes without a chain stay.
    """
    norm = lambda c: F.when(c.rlike("^[0-9a-fA-F]{16}$"), F.lower(c)).otherwise(c)
    placed = placed_chains(chains, nodes).where("on is not null")
    alias = placed.select("trace_id", "chain", F.explode(F.array_distinct(F.flatten(F.transform("on", lambda x: F.array(norm(x["node"]), x["location"]))))).alias("place"))
    rows = causes.withColumn("place", norm(F.trim("location"))).withColumn("_n", F.count("*").over(Window.partitionBy("trace_id")))
    hit = rows.join(alias, ["trace_id", "place"]).groupBy("trace_id", "item").agg(F.min("chain").alias("_hit"))
    first = placed.groupBy("trace_id").agg(F.min("chain").alias("_first"))
    rows = rows.join(hit, ["trace_id", "item"], "left").join(first, "trace_id", "left").withColumn("chain", F.coalesce("_hit", F.when(F.col("_n") == 1, F.col("_first"))))
    both = rows.join(placed.select("trace_id", "chain", "on", "cause_type", F.col("said").alias("_said")), ["trace_id", "chain"], "left")
    to = anchor(F.col("on"), F.col("cause_type"), F.concat_ws(" ", "cause_type", "_said", "said"))
    both = both.withColumn("_to", F.when(F.col("on").isNotNull(), to))
    target = F.coalesce("_to.location", "location")
    return both.select("trace_id", "item", F.col("location").alias("original_location"), target.alias("location"), F.col("_to.rule").alias("rule"), (norm(target) != F.col("place")).alias("moved"))


# --- packs and exports


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types and short texts of both ends."""
    end = lambda side: nodes.select("trace_id", F.col("node_id").alias(side), F.col("type").alias(f"{side}_type"), text.shortened(F.col("content"), 160).alias(f"{side}_text"))
    return edges.join(end("source"), ["trace_id", "source"], "left").join(end("target"), ["trace_id", "target"], "left")


def prompt_pack(nodes: DataFrame, edges: DataFrame, kept: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Of each trace, the kept nodes in order and the edges between them as one JSON text (trace_id, pack); pure packs leave texts out."""
    ids = kept.select("trace_id", "node_id").distinct()
    n = nodes.join(ids, ["trace_id", "node_id"], "left_semi")
    fields = ["ord", F.col("node_id").alias("id"), "type", "saliency"] + ([text.shortened(F.col("content"), 2000).alias("content")] if mode == "hybrid" else [F.length("content").alias("content_chars")])
    e = edges.join(ids.withColumnRenamed("node_id", "source"), ["trace_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["trace_id", "target"], "left_semi")
    ns = n.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
    es = e.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type", "score"))).alias("edges"))
    both = ns.join(es, "trace_id", "left")
    return both.select("trace_id", F.to_json(F.struct(F.lit(mode).alias("mode"), F.size("nodes").alias("node_count"), F.coalesce(F.size("edges"), F.lit(0)).alias("edge_count"), "nodes", "edges")).alias("pack"))


def graph_report(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """Of each trace, its graph as a Markdown document (trace_id, report): counts, the most salient nodes, and its errors."""
    s = graph.summary(nodes, edges)
    counts = F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in s.columns if c != "trace_id"])
    head = s.select("trace_id", F.concat(F.lit("# Trace "), F.col("trace_id").cast("string"), F.lit("\n\n## Counts\n\n"), counts).alias("head"))
    line = F.concat(F.lit("| "), F.col("node_id").cast("string"), F.lit(" | "), F.col("type"), F.lit(" | "), F.format_string("%.4f", F.col("saliency")), F.lit(" | "), markdown_cell(text.shortened(F.col("content"), 160)), F.lit(" |"))
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("saliency"), "ord")))
    top = ranked.where(F.col("rank") <= most).groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("top"))
    wrong = nodes.where("type = 'Error'").groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), F.col("node_id").cast("string")).alias("line")))), lambda x: x["line"]), "\n").alias("errors"))
    out = head.join(top, "trace_id", "left").join(wrong, "trace_id", "left")
    return out.select("trace_id", F.concat("head", F.lit("\n\n## Salient nodes\n\n| node | type | saliency | text |\n|-|-|-|-|\n"), F.coalesce("top", F.lit("")), F.lit("\n\n## Errors\n\n"), F.coalesce("errors", F.lit("none")), F.lit("\n")).alias("report"))


def subgraph_json(nodes: DataFrame, edges: DataFrame, kept: DataFrame, strategy: str) -> DataFrame:
    """Of each trace, what a strategy kept as one JSON text (trace_id, strategy, graph) with how much that is."""
    from spanloom.operators import reports, selection

    ids = kept.select("trace_id", "node_id").distinct()
    inner = nodes.join(ids, ["trace_id", "node_id"], "left_semi")
    s = selection.subgraph_summary(nodes, edges, ids)
    graphs = reports.graph_json(inner, selection.between(edges, ids)).withColumnRenamed("graph", "_graph")
    both = graphs.join(s.select("trace_id", F.to_json(F.struct(*[c for c in s.columns if c != "trace_id"])).alias("_summary")), "trace_id")
    return both.select("trace_id", F.lit(strategy).alias("strategy"), F.concat(F.lit('{"strategy":"'), F.lit(strategy), F.lit('","evaluation":'), "_summary", F.lit(',"graph":'), "_graph", F.lit("}")).alias("graph"))


# Parts of an agent system by the names of their spans.
COMPONENTS = ((r"(?i)agent", "agent"), (r"(?i)litellm|chat|completion", "model"), (r"(?i)tool|execute", "tool"), (r"(?i)step", "planner"))


def component(name: Column) -> Column:
    """Which part of the system a span belongs to."""
    out = F.lit("other")
    for pattern, part in reversed(COMPONENTS):
        out = F.when(name.rlike(pattern), part).otherwise(out)
    return out


def view_payload(nodes: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Of each trace, what a viewer needs as one JSON text (trace_id, payload): nodes, edges, the spans' parents and parts, and counts by part.

    ``spans``: trace_id, span_id, parent_id, name, pos, status.
    """
    ns = nodes.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("id"), "type", text.shortened(F.col("content"), 160).alias("label")))).alias("nodes"))
    es = edges.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("source", "target", "edge_type"))).alias("edges"))
    rows = spans.withColumn("component", component(F.col("name")))
    ss = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pos", "span_id", "parent_id", "name", "component", "status"))).alias("spans"))
    parts = rows.groupBy("trace_id", "component").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Error").alias("errors")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("component", "n", "errors"))).alias("components"))
    out = ns.join(es, "trace_id", "left").join(ss, "trace_id", "left").join(parts, "trace_id", "left")
    return out.select("trace_id", F.to_json(F.struct("nodes", "edges", "spans", "components")).alias("payload"))


def batch_summary(rows: DataFrame, group: str, measures: list[str], ok: Column | None = None) -> DataFrame:
    """One row a group of a batch's results: rows, good ones, and the mean of each measure over those that are numbers, four digits."""
    good = F.count_if(ok) if ok is not None else F.count("*")
    number = lambda c: F.round(F.avg(F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))), 4).alias(f"mean_{c}")
    return rows.groupBy(group).agg(F.count("*").alias("n"), good.alias("n_ok"), *[number(c) for c in measures])
