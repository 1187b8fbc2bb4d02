"""Agents of a trace: which run a span belongs to, how deep, and the edges between agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.lineage import checkpointed
from spanloom.operators import spans as tree


def scopes(spans: DataFrame, is_run: Column) -> DataFrame:
    """Spans with ``agent_id``, the nearest run at or above them, the run's depth (0 for a main agent) and the run above it.

    Spans below no run belong to agent null.
    """
    runs = spans.where(is_run).select("trace_id", "span_id")
    up = tree.ancestors(spans).join(runs.withColumnRenamed("span_id", "ancestor_id"), ["trace_id", "ancestor_id"])
    near = up.groupBy("trace_id", "span_id").agg(F.min_by("ancestor_id", "dist").alias("_above"), F.count("*").alias("_n"))
    rows = spans.withColumn("_run", is_run).join(near, ["trace_id", "span_id"], "left")
    above, n = F.col("_above"), F.coalesce("_n", F.lit(0))
    rows = rows.withColumn("agent_id", F.when(F.col("_run"), F.col("span_id")).otherwise(above))
    depth = F.when(F.col("agent_id").isNotNull(), F.when(F.col("_run"), n).otherwise(n - 1)).cast("int")
    rows = rows.withColumn("agent_depth", depth).withColumn("parent_agent_id", F.when(F.col("_run"), above))
    role = F.when(F.col("agent_depth") == 0, "main").when(F.col("agent_depth") > 0, "subagent")
    return rows.withColumn("agent_role", role).drop("_run", "_above", "_n")


def rollup(scoped: DataFrame) -> DataFrame:
    """Spans and errors of each agent."""
    return scoped.where("agent_id is not null").groupBy("trace_id", "agent_id").agg(F.max("agent_depth").alias("depth"), F.count("*").alias("n_spans"), F.count_if(F.col("status") == "Error").alias("errors"))


def spawn_edges(scoped: DataFrame) -> DataFrame:
    """From each run's parent run to it (AgentSpawn), and from its last span back (SubagentReturn)."""
    runs = scoped.where(F.col("agent_id") == F.col("span_id")).where("parent_agent_id is not null").select("trace_id", "agent_id", "parent_agent_id")
    last = scoped.groupBy("trace_id", "agent_id").agg(F.max_by("span_id", "pos").alias("last"))
    both = runs.join(last, ["trace_id", "agent_id"])
    there = both.select("trace_id", F.col("parent_agent_id").alias("source"), F.col("agent_id").alias("target"), F.lit("AgentSpawn").alias("edge_type"), F.lit(1.0).alias("score"))
    return there.unionByName(both.select("trace_id", F.col("last").alias("source"), F.col("parent_agent_id").alias("target"), F.lit("SubagentReturn").alias("edge_type"), F.lit(0.96).alias("score")))


# Names of model and agent operations, and prefixes of attributes that tell of communication.
OPERATIONS = {"invoke_agent": "CodeAgent.run", "chat": "LiteLLMModel.__call__", "text_completion": "LiteLLMModel.__call__"}
COMMUNICATION = ("http.", "rpc.", "server.", "network.", "net.peer.", "messaging.", "url.")


def enriched(canonical: DataFrame) -> DataFrame:
    """Canonical spans with names and attributes in the engine's own vocabulary, from generative-AI conventions; what is there already stays."""
    a = F.col("attributes")
    operation = a["gen_ai.operation.name"]
    name = F.when(operation == "execute_tool", F.concat(F.coalesce(a["gen_ai.tool.name"], F.lit("")), F.lit("Tool")))
    for k, v in OPERATIONS.items():
        name = F.when(operation == k, v).otherwise(name)
    wanted = {"tool.name": a["gen_ai.tool.name"], "tool.id": a["gen_ai.tool.call.id"], "input.value": F.coalesce(a["gen_ai.tool.call.arguments"], a["gen_ai.input.messages"]), "output.value": F.coalesce(a["gen_ai.tool.call.result"], a["gen_ai.output.messages"]), "otel.original_span_name": F.when(name.isNotNull(), F.col("span_name"))}
    fresh = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in wanted]), F.array(*wanted.values())), lambda k, v: v.isNotNull() & ~F.map_contains_key(a, k))
    return canonical.withColumn("span_name", F.coalesce(name, "span_name")).withColumn("attributes", F.map_concat(a, fresh))


def is_communication(kind: Column, attributes: Column) -> Column:
    """Whether a span talks to another party, by its kind or its attributes."""
    told = F.exists(F.map_keys(attributes), lambda k: F.exists(F.array(*[F.lit(p) for p in COMMUNICATION]), lambda p: k.startswith(p)))
    return F.lower(kind).isin("client", "server", "producer", "consumer") | F.coalesce(told, F.lit(False))


def merged_resources(rows: DataFrame) -> DataFrame:
    """Of each trace and key, the first value by place (trace_id, place, attributes)."""
    flat = rows.select("trace_id", "place", F.explode("attributes").alias("key", "value"))
    return flat.groupBy("trace_id", "key").agg(F.min_by("value", "place").alias("value"))


def outcome_diagnosis(spans: DataFrame) -> DataFrame:
    """Of each trace: whether it ends in a final answer, the spans after the last one, and the failed last span."""
    last = F.max("pos").over(Window.partitionBy("trace_id"))
    rows = spans.withColumn("_l", last)
    return rows.groupBy("trace_id").agg(F.bool_or(F.col("is_final")).alias("answered"), (F.max("pos") - F.coalesce(F.max(F.when(F.col("is_final"), F.col("pos"))), F.lit(0))).alias("after_final"), F.bool_or((F.col("pos") == F.col("_l")) & (F.col("status") == "Error")).alias("ends_in_error"))


# How the names of tools and spans tell that an agent is started.
SPAWN = r"(?:spawn|delegate|create).{0,20}(?:sub.?agent|agent)|(?:sub.?agent|agent).{0,20}(?:spawn|delegate)"


def is_run(name: Column) -> Column:
    """Whether a span is the run of an agent."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.contains(low, F.lit("agent")) & low.endswith(".run")


def is_spawn(tool: Column, name: Column) -> Column:
    """Whether a span starts another agent."""
    return F.lower(F.concat_ws(" ", tool, name)).rlike(SPAWN)


def started_by(spans: DataFrame, closure: DataFrame) -> DataFrame:
    """Runs (trace_id, span_id, spawn_id) that begin a scope of their own: the closest run below each span that starts an agent; of several such spans the last counts."""
    runs = spans.where(is_run(F.col("name"))).select("trace_id", "span_id", F.col("pos").alias("_at"))
    starts = spans.where(is_spawn(F.col("tool"), F.col("name"))).select("trace_id", F.col("span_id").alias("ancestor_id"), F.col("pos").alias("_from"))
    below = closure.join(starts, ["trace_id", "ancestor_id"]).join(runs, ["trace_id", "span_id"])
    closest = below.groupBy("trace_id", "ancestor_id", "_from").agg(F.min_by("span_id", F.struct("dist", "_at")).alias("span_id"))
    return closest.groupBy("trace_id", "span_id").agg(F.max_by("ancestor_id", "_from").alias("spawn_id"))


def inferred_scopes(spans: DataFrame) -> DataFrame:
    """Spans (trace_id, span_id, parent_id, pos, name, tool, task; maybe speaker) with the agent that each belongs to, found from what started what.

    A span belongs to the nearest started run at or above it, else to the topmost run above it, the main agent; where there is none,
    to a main agent without an id. One with a ``speaker`` belongs to that participant. Adds agent_id, agent_role, agent_depth, parent_agent_id,
    spawn_span_id, agent_path (from the main agent down) and agent_task.
    """
    closure = checkpointed(tree.ancestors(checkpointed(spans.select("trace_id", "span_id", "parent_id"))))
    begun = started_by(spans, closure)
    above = closure.unionByName(spans.select("trace_id", "span_id", F.col("span_id").alias("ancestor_id"), F.lit(0).alias("dist")))
    near = above.join(begun.select("trace_id", F.col("span_id").alias("ancestor_id")), ["trace_id", "ancestor_id"]).groupBy("trace_id", "span_id").agg(F.min_by("ancestor_id", "dist").alias("_near"))
    runs = spans.where(is_run(F.col("name"))).select("trace_id", F.col("span_id").alias("ancestor_id"))
    top = above.join(runs, ["trace_id", "ancestor_id"]).groupBy("trace_id", "span_id").agg(F.max_by("ancestor_id", "dist").alias("_top"))
    own = checkpointed(spans.select("trace_id", "span_id").distinct().join(near, ["trace_id", "span_id"], "left").join(top, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.coalesce("_near", "_top").alias("agent_id"), F.col("_near").isNotNull().alias("_sub")))
    # scopes form a tree: that of a started run hangs below the scope of the span that started it
    parent = begun.join(own.select("trace_id", F.col("span_id").alias("spawn_id"), F.col("agent_id").alias("parent_agent_id")), ["trace_id", "spawn_id"])
    links = tree.ancestors(parent.select("trace_id", "span_id", F.col("parent_agent_id").alias("parent_id")))
    line = links.groupBy("trace_id", F.col("span_id").alias("agent_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "ancestor_id"))), lambda x: x["ancestor_id"]).alias("_line"))
    tasks = spans.select("trace_id", F.col("span_id").alias("agent_id"), F.left(F.trim(F.regexp_replace(F.coalesce("task", F.lit("")), "^user:", "")), F.lit(240)).alias("agent_task"))
    out = spans.join(own, ["trace_id", "span_id"]).join(parent.select("trace_id", F.col("span_id").alias("agent_id"), "parent_agent_id", F.col("spawn_id").alias("spawn_span_id")), ["trace_id", "agent_id"], "left").join(line, ["trace_id", "agent_id"], "left").join(tasks, ["trace_id", "agent_id"], "left")
    kind = dict(spans.dtypes)["span_id"]
    path = F.concat(F.coalesce("_line", F.array().cast(f"array<{kind}>")), F.when(F.col("agent_id").isNotNull(), F.array("agent_id")).otherwise(F.array().cast(f"array<{kind}>")))
    said = F.nullif(F.trim("speaker"), F.lit("")) if "speaker" in spans.columns else F.lit(None).cast("string")
    role = F.when(said.isNotNull(), "participant").when(F.col("_sub"), "subagent").otherwise("main")
    return out.select(*spans.columns, F.coalesce(said, F.col("agent_id").cast("string")).alias("agent_id"), role.alias("agent_role"), F.when(F.col("_sub"), F.coalesce(F.size("_line"), F.lit(0))).otherwise(0).alias("agent_depth"), "parent_agent_id", "spawn_span_id", path.alias("agent_path"), "agent_task")


# Resource attributes that tell of the place where a span ran.
RESOURCE = ("container.", "k8s.", "cloud.", "host.", "process.", "service.", "deployment.")


def virtualization(rows: DataFrame) -> DataFrame:
    """Where each trace ran, from its resource attributes (trace_id, place, attributes): runtime, services, containers and how many attributes tell of it."""
    flat = rows.select("trace_id", "place", F.explode("attributes").alias("key", "value")).where("value is not null and value != ''")
    told = F.exists(F.array(*[F.lit(p) for p in RESOURCE]), lambda p: F.startswith(F.col("key"), p))
    first = flat.groupBy("trace_id", "key").agg(F.min_by("value", "place").alias("value"), F.collect_set(F.when(F.col("key") == "service.name", F.col("value"))).alias("names")).withColumn("_told", told)
    has = lambda p: F.bool_or(F.col("_told") & F.col("key").startswith(p))
    runtime = F.when(has("k8s."), "Kubernetes").when(has("container."), "Container").when(has("cloud."), "Cloud VM").when(F.bool_or(F.col("key").isin("host.id", "host.name")), "Host/VM").otherwise("unknown")
    out = first.groupBy("trace_id").agg(runtime.alias("runtime"), F.sum(F.size("names")).alias("services"), F.count_distinct(F.when(F.col("key").isin("container.id", "container.name", "k8s.pod.uid", "k8s.pod.name"), F.col("value"))).alias("containers"), F.count_if("_told").alias("attributes"))
    return out.withColumn("status", F.when(F.col("attributes") > 0, "healthy").otherwise("unknown"))
