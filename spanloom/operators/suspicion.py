"""How suspicious nodes are, and which made what later failed: all as relational plans over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers, text

# Bonuses of node types and words that tell of failures, tools, changes of plan and retries.
TYPE_BONUS = {"Error": 5.0, "Conclusion": 4.2, "Action": 3.3, "Planning": 3.0, "Fact": 1.8, "Intent": 1.4}
FAILURE_WORDS = ("error", "failed", "failure", "invalid", "timeout", "timed out", "exception", "forbidden", "unauthorized", "authentication", "permission", "service unavailable", "404", "403", "500", "insufficient", "not found")
TOOL_WORDS = ("tool", "function", "api", "call", "args", "params", "parameter", "format", "json", "schema", "browser", "search", "bash", "python", "final_answer")
DRIFT_WORDS = ("need to", "should", "let me", "next", "then", "instead", "verify", "double-check", "rethink", "plan")
RETRY_WORDS = ("retry", "again", "re-run", "rerun", "try another", "another attempt")
DOUBT_WORDS = ("error", "failed", "invalid", "wrong", "incorrect", "unsupported", "hallucinat", "irrelevant", "not found", "missing", "no evidence", "contradict", "timeout", "exception")
EVIDENCE_WORDS = ("search", "result", "evidence", "retrieved", "google", "web")
FORMAT_WORDS = ("format", "schema", "invalid", "missing required tag", "kwargs")
# Words of nodes that make something, use it, leave it in a bad state, distract, repair, and of what controls others.
PRODUCER_WORDS = ("write_text", "write_bytes", ".write(", ".write_", "create", "write", "store", "patch")
CONSUMER_WORDS = ("read_text", ".read(", "json.loads", "pickle.load", "subprocess.run", "connect", "print(", "open(")
BAD_STATE_WORDS = ("missing", "nonexistent", "stale", "invalid", "malformed", "unsafe", "wrong", "low", "closed", "unset", "empty", "bad", "impossible", "over-escaped", "fallback", "required")
DISTRACTOR_WORDS = ("readme.md", "pyproject.toml", "stream_utils.py", "chat.py", "get-content", "select-object", "list server", "repository")
CONTROL_WORDS = ("base", "command", "config", "date", "env", "key", "manifest", "model", "payload", "policy", "pointer", "port", "rate", "record", "regex", "route")
RECOVERY_WORDS = ("fallback", "patch", "repair", "retry", "recovery", "replace", "unsafe default", "now succeeds")


def hits(t: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(t, F.lit(w)).cast("int")
    return out


def neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with ``near_failure`` (it or a neighbour fails), ``is_retry`` (its words or a Retry edge say so) and ``is_bridge`` (a plan before an action, or such an action)."""
    low = F.lower(F.coalesce("content", F.lit("")))
    rows = nodes.withColumn("_fails", (F.col("type") == "Error") | (hits(low, FAILURE_WORDS) > 0)).withColumn("_again", hits(low, RETRY_WORDS) > 0)
    ends = edges.select("trace_id", F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.col("target").alias("other"), F.col("edge_type").alias("kind"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node_id"), F.col("source").alias("other"), F.col("edge_type").alias("kind"), F.lit(False).alias("out")))).alias("x")).select("trace_id", "x.*")
    others = rows.select("trace_id", F.col("node_id").alias("other"), "_fails", F.col("type").alias("_kind"))
    of = F.coalesce(F.col("_kind"), F.lit(""))
    seen = ends.join(others, ["trace_id", "other"], "left").groupBy("trace_id", "node_id").agg(
        F.bool_or(F.coalesce("_fails", F.lit(False))).alias("_near"), F.bool_or(F.col("kind") == "Retry").alias("_retried"), F.bool_or(F.col("out") & (of == "Action")).alias("_acts"), F.bool_or(~F.col("out") & (of == "Planning")).alias("_planned")
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.join(seen, ["trace_id", "node_id"], "left")
    bridge = ((F.col("type") == "Planning") & flag("_acts")) | ((F.col("type") == "Action") & flag("_planned"))
    return rows.select(*nodes.columns, (F.col("_fails") | flag("_near")).alias("near_failure"), (F.col("_again") | flag("_retried")).alias("is_retry"), bridge.alias("is_bridge"))


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``neighbourhoods`` of nodes with saliency, and what ranking needs of their texts, in place of these.

    ``base_score`` is the suspicion so far: saliency, type, words and neighbourhood, less for long facts that say nothing of failures.
    Repeated tools and the way to the outcome are added where these are known.
    """
    rows = neighbourhoods(nodes, edges)
    low = F.lower(F.coalesce("content", F.lit("")))
    fails, tools = hits(low, FAILURE_WORDS), hits(low, TOOL_WORDS)
    add = lambda n, each, most: F.least(F.lit(most), n * each)
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    long_fact = (F.col("type") == "Fact") & (F.length("content") > 1200) & (fails == 0) & (tools <= 1)
    score = F.col("saliency") + numbers.of(TYPE_BONUS, F.col("type"), 0.8) + add(fails, 0.65, 3.0) + add(tools, 0.18, 1.8) + add(hits(low, DRIFT_WORDS), 0.25, 1.2) + add(hits(low, RETRY_WORDS), 0.4, 1.0)
    score = score + yes(F.col("is_retry"), 1.8) + yes(F.col("near_failure"), 1.2) + yes(F.col("is_bridge"), 0.8) - yes(long_fact, 0.9)
    cue = F.contains(low, F.lit("final answer")) | F.contains(low, F.lit("final response")) | F.contains(low, F.lit("final_answer"))
    violation = F.col("violation_types") if "violation_types" in nodes.columns else F.array().cast("array<string>")
    explicit = F.col("semantic_error_score") if "semantic_error_score" in nodes.columns else F.lit(0.0)
    return rows.select(
        "trace_id", "node_id", "ord", "type", "saliency", F.length(F.coalesce("content", F.lit(""))).alias("size"), F.lower(text.tool_name(F.col("content"))).alias("tool"), text.lexical_tokens(F.col("content")).alias("words"),
        F.least(F.lit(1.0), hits(low, DOUBT_WORDS) * 0.2).alias("doubt"), F.coalesce(explicit, F.lit(0.0)).alias("semantic"), cue.alias("final_cue"), ((F.col("type") == "Action") & F.contains(low, F.lit("final_answer"))).alias("final_action"),
        "near_failure", "is_retry", "is_bridge", F.round(score, 6).alias("base_score"), root_cause_type(F.col("type"), low, F.col("is_retry"), F.coalesce(violation, F.array().cast("array<string>"))).alias("cause_type"),
    )


def root_cause_type(kind: Column, low: Column, is_retry: Column, violations: Column) -> Column:
    """What sort of root cause a node would be: by its violations, else its words, neighbourhood and type."""
    has = lambda v: F.array_contains(violations, v)
    return (
        F.when(has("entity_mismatch"), "entity_resolution_mismatch").when(has("ungrounded_tool_argument"), "unverified_tool_argument").when(has("argument_result_mismatch"), "tool_contract_mismatch").when(has("temporal_mismatch"), "temporal_constraint_mismatch")
        .when(hits(low, FORMAT_WORDS) > 0, "format_or_tool_argument_error").when(is_retry, "retry_or_recovery_failure").when((kind == "Error") | (hits(low, FAILURE_WORDS) > 0), "tool_or_execution_failure")
        .when((kind == "Fact") & (hits(low, EVIDENCE_WORDS) > 0), "wrong_or_low_quality_evidence_used").when(kind == "Planning", "unsupported_or_invalid_reasoning").when(kind == "Action", "wrong_action_or_tool_choice")
        .when(kind == "Conclusion", "final_answer_symptom").otherwise("agent_trace_failure")
    )


def tool_frequencies(nodes: DataFrame) -> DataFrame:
    """How many nodes of each trace name each tool."""
    return nodes.select("trace_id", F.lower(text.tool_name(F.col("content"))).alias("tool")).where("tool != ''").groupBy("trace_id", "tool").agg(F.count("*").alias("n"))


def produced_faults(nodes: DataFrame, ranking: DataFrame | None = None, most: int = 12) -> DataFrame:
    """Actions that make an artifact, with the first later node that uses it and the failure that follows, the likeliest first.

    Returns trace_id, rank, producer, role, consumer, error, score. ``ranking`` (trace_id, node_id, score) adds what paths say of a node.
    """
    low = F.lower(F.coalesce("content", F.lit("")))
    rows = nodes.select("trace_id", "node_id", "ord", "type", low.alias("low"), text.artifact_keys(F.col("content")).alias("artifacts"))
    rows = rows.withColumn("next_error", F.last(F.when(F.col("type") == "Error", F.col("node_id")), True).over(Window.partitionBy("trace_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)))
    uses = (F.col("type") == "Error") | (F.col("type").isin("Action", "Fact", "Conclusion") & ((hits(F.col("low"), CONSUMER_WORDS) > 0) | (hits(F.col("low"), FAILURE_WORDS) > 0)))
    made = rows.where((F.col("type") == "Action") & (hits(F.col("low"), PRODUCER_WORDS) > 0) & (F.size("artifacts") > 0))
    each = made.select("trace_id", "node_id", "ord", F.explode("artifacts").alias("artifact"))
    earlier = each.withColumn("_first", F.min("ord").over(Window.partitionBy("trace_id", "artifact"))).groupBy("trace_id", "node_id").agg(F.bool_or(F.col("_first") < F.col("ord")).alias("earlier"))
    used = rows.where(uses).select("trace_id", F.col("node_id").alias("consumer"), F.col("ord").alias("then"), F.when(F.col("type") == "Error", F.col("node_id")).otherwise(F.col("next_error")).alias("error"), F.explode("artifacts").alias("artifact"))
    # as of each artifact's next use: one row a producer and artifact, not one a pair
    w = Window.partitionBy("trace_id", "artifact").orderBy(F.desc("at"), F.col("maker").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    line = each.select("trace_id", "artifact", F.col("ord").alias("at"), F.col("node_id").alias("maker"), F.lit(None).cast("struct<then:int,consumer:bigint,error:bigint>").alias("use"))
    line = line.unionByName(used.select("trace_id", "artifact", F.col("then").alias("at"), F.lit(None).cast("bigint").alias("maker"), F.struct(F.col("then").cast("int").alias("then"), F.col("consumer").cast("bigint").alias("consumer"), F.col("error").cast("bigint").alias("error")).alias("use")))
    after = line.withColumn("next", F.last("use", True).over(w)).where("maker is not null").groupBy("trace_id", F.col("maker").alias("node_id")).agg(F.min("next").alias("use"))
    score = ranking.select("trace_id", "node_id", F.col("score").alias("_chain")) if ranking is not None else None
    out = made.join(earlier, ["trace_id", "node_id"]).join(after, ["trace_id", "node_id"], "left")
    out = out.join(score, ["trace_id", "node_id"], "left") if score is not None else out.withColumn("_chain", F.lit(0.0))
    add = lambda n, each, most: F.least(F.lit(most), n * each)
    hints = F.aggregate("artifacts", F.lit(0), lambda acc, x: acc + hits(x, CONTROL_WORDS))
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    total = 1.0 + add(hits(F.col("low"), BAD_STATE_WORDS), 0.35, 2.0) + yes(F.col("use.consumer").isNotNull(), 0.9) + yes(F.col("use.error").isNotNull(), 0.5) + add(hints, 0.15, 0.45) + F.least(F.lit(1.0), F.coalesce("_chain", F.lit(0.0)))
    total = total - add(hits(F.col("low"), DISTRACTOR_WORDS), 0.25, 0.8) - add(hits(F.col("low"), RECOVERY_WORDS), 0.3, 0.9) - yes(F.col("earlier"), 0.55)
    out = out.select("trace_id", F.col("node_id").alias("producer"), "ord", F.when(F.col("use.consumer").isNotNull(), "upstream_state_producer").otherwise("possible_state_producer").alias("role"), F.col("use.consumer").alias("consumer"), F.col("use.error").alias("error"), F.round(total, 4).alias("score"))
    best = Window.partitionBy("trace_id").orderBy(F.desc("score"), F.desc(F.col("role") == "upstream_state_producer"), "ord")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("trace_id", "rank", "producer", "role", "consumer", "error", "score")
