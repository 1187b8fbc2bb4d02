"""Views of the test tables as canonical tables of the engine: spans, nodes, monitoring events, samples, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as one trace of tool spans; a sign-up is the parent of what follows it."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("trace_id"),
        F.col("event_id").alias("span_id"),
        F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("parent_id"),
        F.col("ts"),
        F.row_number().over(w).alias("pos"),
        F.col("event_type").alias("tool"),
        F.col("props").alias("input"),
        F.concat(F.lit("Tool: "), "event_type", F.lit(" | Args: "), "props").alias("content"),
        F.col("value").alias("duration"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Ok").alias("status"),
        (F.col("event_type") == "purchase").alias("is_final"),
    )


def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dialogue histories, a row a turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").cast("int").alias("step"), "role", F.col("text").alias("content"))


def tree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, orders and order lines as one forest of spans, five levels deep."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("region").select(key("R", "r_regionkey").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("input")),
        t("nation").select(key("N", "n_nationkey"), key("R", "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))),
        t("customer").select(key("C", "c_custkey"), key("N", "c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))),
        t("orders").select(key("O", "o_orderkey"), key("C", "o_custkey"), F.lit("")),
        t("lineitem").select(F.concat_ws("-", key("L", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"), key("O", "l_orderkey"), F.lit(None).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.lit(0).alias("trace_id"), "*")


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the nodes of one graph; the last one is its conclusion."""
    d = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    last = F.lead("doc_id").over(w).isNull()
    kind = F.when(last, "Conclusion").when(F.col("lang") == "en", "Fact").when(F.col("lang") == "de", "Action").when(F.col("lang") == "es", "Planning").otherwise("Error")
    return d.select(F.col("source").alias("trace_id"), F.col("doc_id").alias("node_id"), F.row_number().over(w).alias("ord"), kind.alias("type"), F.col("text").alias("content"))


def monitor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as monitoring events; errors carry a layer that doesn't exist."""
    layer = F.when(F.col("event_type") == "view", "hardware").when(F.col("event_type") == "signup", "virtualization").when(F.col("event_type") == "click", "communication").when(F.col("event_type") == "purchase", "application").otherwise("invalid")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("system_id"), layer.alias("layer"), F.col("value").alias("measurement"))


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples of accelerators."""
    names = F.array(*[F.lit(x) for x in ("utilization", "memory_used", "temperature", "errors")])
    pos = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("device"), F.col("l_returnflag").alias("pod"), names[(F.col("l_linenumber") % 4).cast("int")].alias("metric"), F.col("l_quantity").alias("value"), pos.alias("pos"))


def alignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as human findings, each with an automatic one: impact and location of both."""
    human = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "HIGH").when(F.col("quality") == 0, "MEDIUM").otherwise("LOW")
    auto = F.when(F.col("n_chars") < 800, "HIGH").when(F.col("n_chars") < 2500, "MEDIUM").otherwise("LOW")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("trace_id"), F.col("doc_id").alias("item"), human.alias("human_impact"), auto.alias("auto_impact"),
        F.concat(F.lit("F_"), F.col("doc_id").cast("string")).alias("human_location"),
        F.when(F.col("doc_id") % 5 == 4, "unknown").otherwise(F.concat(F.lit("f_"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string"))).alias("auto_location"),
    )


def tool_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as canonical spans of an agent: the first turn is its task, odd turns call a model, further even ones a tool.

    Texts of results and answers follow from the numbers of conversation and turn, so that links of every state occur.
    """
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), "turn")
    w = Window.partitionBy("c").orderBy("turn")
    t = t.withColumn("t", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    c, k = F.col("c").cast("string"), F.col("t").cast("string")
    run, model = F.col("t") == 0, F.col("t") % 2 == 1
    facts = lambda p: [F.concat(F.lit("dist "), p.cast("string"), F.lit("0 km")), F.concat(F.lit("mass "), (F.col("c") % 50).cast("string"), F.lit(".5 kg")), F.concat(F.lit("code "), c, F.lit("-"), p.cast("string"))]
    host = F.concat(F.lit("host"), (F.col("c") % 7).cast("string"), F.lit(".example"))
    status = F.when(F.col("c") % 9 == 4, "Status: 404").otherwise("Status: 200")
    result = F.when((F.col("c") + F.col("t")) % 7 == 0, "").when((F.col("c") + F.col("t")) % 11 == 0, '{"success":false,"error":"down","city":"B"}').otherwise(F.concat_ws("\n", *facts(F.col("t")), F.concat(F.lit("as of 2024-03-1"), k), status))
    arguments = F.when(F.col("c") % 2 == 0, F.concat(F.lit('{"url":"http://www.'), host, F.lit('/doc/abcdefg'), c, F.lit('1","city":"a"}'))).otherwise(F.concat(F.lit('{"query":"code","ref_id":"opaque'), c, F.lit("x"), k, F.lit('"}')))
    before = F.col("t") - 1
    mode = (F.col("c") + F.col("t")) % 5
    used = facts(before)
    said = F.when(mode == 0, "nothing").when(mode == 1, used[2]).when(mode == 2, F.concat_ws(" ", *used)).when(mode == 3, F.concat(F.lit("outdated "), host, F.lit(" "), used[0])).otherwise(F.concat_ws("\n", *used))
    output = F.concat(F.lit("turn "), k, F.lit("\n"), said)
    call = lambda i: F.concat(F.lit("call_"), c, F.lit("_"), i.cast("string"))
    shown = F.when((F.col("c") % 3 != 0) & (before >= 2), F.concat(F.lit('[{"role":"user","content":"x"},{"role":"tool","tool_call_id":"'), call(before), F.lit('","content":"r"}]'))).otherwise("[]")
    asks = F.when(F.col("t") + 1 < F.col("n"), F.concat(F.lit('[{"role":"assistant","content":"go","tool_calls":["'), call(F.col("t") + 1), F.lit('"]}]'))).otherwise('[{"role":"assistant","content":"end"}]')
    task = F.concat(F.lit('Please find "code"'), F.when(F.col("c") % 4 == 0, " of 2024-03-12").otherwise(""))
    pairs = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    attributes = F.when(run, pairs("input.value", task)).when(model, pairs("otel.original_span_name", "gen_ai.chat", "llm.output_messages.0.message.content", output, "gen_ai.input.messages", shown, "gen_ai.output.messages", asks)).otherwise(
        pairs("tool.name", "lookup", "tool.id", call(F.col("t")), "tool.parameters", F.when(F.col("c") % 5 == 0, '{"required":["url"]}').otherwise("{}"), "input.value", arguments, "output.value", result)
    )
    inner = (F.col("c") % 6 == 0) & (F.col("t") == 3)
    parent = F.when(~run, F.concat(F.lit("s"), c, F.when(inner, "_2").otherwise("_0")))
    name = F.when(run, "CodeAgent.run").when(model, "chat").otherwise("tool")
    return t.select(F.col("c").alias("trace_id"), F.concat(F.lit("s"), c, F.lit("_"), k).alias("span_id"), parent.alias("parent_id"), F.lpad(k, 3, "0").alias("ts"), F.col("t").alias("pos"), name.alias("name"), F.when((F.col("c") + F.col("t")) % 13 == 0, "Error").otherwise("Ok").alias("status"), attributes.alias("attributes"))


def artifact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nodes of an agent that writes files, reads them and fails on them; searches and plans lie between."""
    e = event_spans(spark, sf_dir)
    k = (F.col("span_id") % 7).cast("string")
    t, n = F.col("tool"), F.col("pos")
    said = F.when(t == "click", F.concat(F.lit("Tool: editor | write config_"), k, F.lit(".json"), F.when(n % 3 == 0, " with a stale value").otherwise("")))
    said = said.when(t == "error", F.concat(F.lit("failed on config_"), k, F.lit(".json"))).when(t == "view", F.concat(F.lit("search result of json.loads config_"), k, F.lit(".json"))).when(t == "purchase", "the final answer is here").otherwise(F.concat(F.lit("let me plan step "), k))
    kind = F.when(t == "click", "Action").when(t == "error", "Error").when(t == "view", "Fact").when(t == "purchase", "Conclusion").otherwise("Planning")
    return e.select("trace_id", F.col("span_id").alias("node_id"), F.col("pos").alias("ord"), kind.alias("type"), said.alias("content"), F.col("span_id"), F.col("parent_id"), "tool", F.col("pos").alias("step"))
