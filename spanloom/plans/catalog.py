"""Queries over the test tables, one or more for every operator of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import lenses
from spanloom.functions import numbers, text
from spanloom.operators import agents, alignment, digests, evaluation, extraction, graph, graph_algorithms, judgements, judging, monitoring, ranking, reports, selection, semantics, spans, strategies, suspicion, target_paths, validation
from spanloom.sources import datasets, metrics, traces

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a query under its name."""
    QUERIES[f.__name__] = f
    return f


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.span_graph(lenses.event_spans(spark, d))


# --- spans and faults


@query
def q_fault_findings_union(spark, d):
    return spans.fault_findings(lenses.event_spans(spark, d))


@query
def q_span_flatten_order(spark, d):
    return spans.in_order(lenses.event_spans(spark, d)).select("trace_id", "span_id", "seq")


@query
def q_parent_join_roots(spark, d):
    rows = spans.with_parent(lenses.tree_spans(spark, d))
    return rows.groupBy(F.left("span_id", F.lit(1)).alias("level")).agg(F.count("*").alias("n_spans"), F.count_if("is_root").alias("n_roots"))


@query
def q_ancestor_closure(spark, d):
    rows = spans.ancestors(lenses.tree_spans(spark, d))
    return rows.groupBy(F.left("ancestor_id", F.lit(1)).alias("level"), "dist").agg(F.count("*").alias("n"), F.count_distinct("ancestor_id").alias("ancestors"))


@query
def q_nearest_ancestor_task(spark, d):
    return spans.nearest_ancestor(lenses.tree_spans(spark, d), F.col("input"), "task").groupBy("task").agg(F.count("*").alias("n"), F.max("dist").alias("max_dist"))


@query
def q_descendants(spark, d):
    return spans.descendants_count(lenses.tree_spans(spark, d)).select("span_id", "descendants")


@query
def q_status_decode(spark, d):
    s = validation.result_status(F.col("status"), F.col("content"))
    return lenses.event_spans(spark, d).select("trace_id", "span_id", s.alias("s")).select("trace_id", "span_id", "s.*")


@query
def q_violations(spark, d):
    rows = lenses.event_spans(spark, d).withColumn("output", F.when(F.col("tool") == "view", "Status: 404").when(F.col("tool") == "click", "[]").otherwise("fine")).withColumn("required", F.when(F.col("tool") == "signup", F.array(F.lit("k"), F.lit("user"))).otherwise(F.array(F.lit("k"))))
    return validation.violations(rows).groupBy("trace_id", "violation_type", "severity").agg(F.count("*").alias("n"))


@query
def q_action_loop(spark, d):
    return spans.repeated_attempts(lenses.event_spans(spark, d))


@query
def q_failed_retry(spark, d):
    return spans.failed_retries(lenses.event_spans(spark, d))


@query
def q_error_before_final(spark, d):
    return spans.errors_before_final(lenses.event_spans(spark, d))


@query
def q_shared_parent_cascade(spark, d):
    return spans.shared_parent_errors(lenses.event_spans(spark, d))


# --- graph


@query
def q_temporal_edges(spark, d):
    return graph.temporal_edges(graph.nodes_of_spans(lenses.event_spans(spark, d)))


@query
def q_retry_edges(spark, d):
    return graph.retry_edges(graph.nodes_of_spans(lenses.event_spans(spark, d)))


@query
def q_observation_edges(spark, d):
    return graph.observation_edges(graph.nodes_of_spans(lenses.event_spans(spark, d)))


@query
def q_call_edges(spark, d):
    return graph.call_edges(graph.nodes_of_spans(lenses.event_spans(spark, d)))


@query
def q_dialogue_reply_edges(spark, d):
    return graph.reply_edges(graph.node_ids(lenses.dialogue_turns(spark, d)))


@query
def q_node_ids(spark, d):
    return graph.node_ids(lenses.dialogue_turns(spark, d)).select("trace_id", "node_id", "ord", "type")


@query
def q_node_dedup(spark, d):
    return graph.deduplicated(lenses.corpus_nodes(spark, d)).select("trace_id", "node_id", "ord", "type", "occurrences")


@query
def q_saliency(spark, d):
    return graph.saliency(lenses.corpus_nodes(spark, d)).select("trace_id", "node_id", "saliency")


@query
def q_cognitive_topk(spark, d):
    return graph.cognitive_edges(lenses.corpus_nodes(spark, d))


@query
def q_edge_type_counts(spark, d):
    return graph.edge_type_counts(_graph(spark, d)[1])


@query
def q_graph_summary(spark, d):
    return graph.summary(*_graph(spark, d))


@query
def q_degree(spark, d):
    return graph.degrees(_graph(spark, d)[1])


@query
def q_simple_edges(spark, d):
    return graph.simple_edges(_graph(spark, d)[1])


@query
def q_edge_cost(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.typed_edges(edges, nodes)


# --- selection


@query
def q_salient_budget(spark, d):
    return selection.salient(graph.saliency(lenses.corpus_nodes(spark, d)))


@query
def q_prune_coverage(spark, d):
    nodes = graph.saliency(lenses.corpus_nodes(spark, d))
    return selection.coverage(selection.salient(nodes), nodes)


@query
def q_anomaly_topk(spark, d):
    return selection.anomalies(graph.saliency(lenses.corpus_nodes(spark, d)))


@query
def q_bm25(spark, d):
    nodes = lenses.corpus_nodes(spark, d)
    return selection.bm25(nodes, selection.anchors(nodes))


@query
def q_tfidf(spark, d):
    nodes = lenses.corpus_nodes(spark, d)
    return selection.tfidf(nodes, selection.anchors(nodes))


@query
def q_temporal_window(spark, d):
    return selection.temporal_window(lenses.corpus_nodes(spark, d), F.col("type").isin("Conclusion", "Planning"))


@query
def q_anomaly_neighborhood(spark, d):
    nodes, edges = _graph(spark, d)
    return selection.neighbourhood(selection.anomalies(graph.saliency(nodes)), edges)


@query
def q_outcome_slice(spark, d):
    nodes, edges = _graph(spark, d)
    return selection.backward_slice(selection.anchors(nodes), edges)


def _per_trace(strategy: str) -> Query:
    def run(spark, d):
        nodes, edges = _graph(spark, d)
        return graph_algorithms.prune(graph.saliency(nodes), edges, strategy)

    run.__name__ = f"q_{strategy}"
    return run


for _s in graph_algorithms.STRATEGIES:
    query(_per_trace(_s))


@query
def q_tgspe_ranking(spark, d):
    nodes, edges = _graph(spark, d)
    return ranking.root_causes(graph.saliency(nodes), graph.typed_edges(edges, nodes))


@query
def q_tgspe_chains(spark, d):
    nodes, edges = _graph(spark, d)
    return ranking.diverse_chains(ranking.root_causes(graph.saliency(nodes), graph.typed_edges(edges, nodes)))


@query
def q_rca_table(spark, d):
    return ranking.producers(graph.saliency(graph.nodes_of_spans(lenses.event_spans(spark, d))))


# --- validation and dialogue


@query
def q_origin_asof(spark, d):
    return validation.repeats_of(lenses.event_spans(spark, d))


@query
def q_prior_evidence(spark, d):
    return validation.prior_evidence(lenses.dialogue_turns(spark, d))


@query
def q_delivery_states(spark, d):
    return validation.delivery_links(lenses.dialogue_turns(spark, d))


@query
def q_propagation_final(spark, d):
    turns = lenses.dialogue_turns(spark, d)
    return validation.propagation(validation.delivery_links(turns), validation.final_steps(turns))


@query
def q_msg_role_counts(spark, d):
    return validation.role_counts(lenses.dialogue_turns(spark, d))


@query
def q_checklist_fill(spark, d):
    j = lenses.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("trace_id"), F.get(F.array(*[F.lit(c) for c in validation.CHECKS]), F.col("n_nationkey") % 9).alias("check"), F.when(F.col("n_nationkey") % 3 == 0, "fail").otherwise("pass").alias("verdict")).groupBy("trace_id", "check").agg(F.min("verdict").alias("verdict"))
    return validation.filled_checks(j)


# --- text


@query
def q_token_estimate(spark, d):
    return lenses.table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query
def q_middle_truncate(spark, d):
    return lenses.table(spark, d, "documents").select("doc_id", F.md5(text.middle_cut(F.col("text"), 1200)).alias("cut_md5"))


@query
def q_content_flags(spark, d):
    return lenses.table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in text.content_flags(F.col("text")).items()])


@query
def q_fingerprint(spark, d):
    t = F.col("text")
    return lenses.table(spark, d, "documents").select("doc_id", F.md5(text.fingerprint(t)).alias("fingerprint"), F.md5(text.shortened(t, 160)).alias("display"), F.size(text.ids_in(t)).cast("long").alias("n_ids"))


@query
def q_tool_names(spark, d):
    c = F.col("content")
    return lenses.event_spans(spark, d).select("trace_id", "span_id", text.tool_name(c).alias("tool"), F.md5(text.safe_id(c)).alias("safe"), F.size(text.artifact_keys(c)).cast("long").alias("n_artifacts"))


@query
def q_bytes_label(spark, d):
    return lenses.table(spark, d, "documents").select("doc_id", text.bytes_label(F.col("n_chars").cast("double") * F.pow(F.lit(10.0), (F.col("doc_id") % 10).cast("double"))).alias("label"))


# --- monitoring


@query
def q_latency_percentiles(spark, d):
    return monitoring.latency(lenses.event_spans(spark, d)).select("trace_id", "total", "p50_ms", "p95_ms", "protocols")


@query
def q_comm_error_rate(spark, d):
    return monitoring.latency(lenses.event_spans(spark, d)).select("trace_id", "errors", "retries", "error_rate", "status")


@query
def q_layer_rollup(spark, d):
    return monitoring.layer_rollup(monitoring.accepted(lenses.monitor_events(spark, d)))


@query
def q_monitor_reject(spark, d):
    return monitoring.validated(lenses.monitor_events(spark, d)).groupBy("layer", "error").agg(F.count("*").alias("n"))


@query
def q_monitor_range(spark, d):
    return monitoring.in_range(monitoring.accepted(lenses.monitor_events(spark, d)), layer="hardware", limit=500)


@query
def q_monitor_retained(spark, d):
    return monitoring.retained(monitoring.accepted(lenses.monitor_events(spark, d)), 1000).groupBy("layer").agg(F.count("*").alias("n"), F.min("seq").alias("oldest"))


@query
def q_monitor_snapshot(spark, d):
    return monitoring.snapshot(monitoring.accepted(lenses.monitor_events(spark, d)))


@query
def q_accelerator_rollup(spark, d):
    return monitoring.accelerators(lenses.metric_samples(spark, d))


@query
def q_counter_delta(spark, d):
    return monitoring.counter_deltas(lenses.event_spans(spark, d), "duration").select("trace_id", "span_id", F.round("delta", 4).alias("delta"))


@query
def q_event_correlation(spark, d):
    return monitoring.correlated(monitoring.accepted(lenses.monitor_events(spark, d)), lenses.event_spans(spark, d))


@query
def q_k8s_quantity(spark, d):
    units = F.array(*[F.lit(u) for u in ("m", "Ki", "Mi", "", "G", "n", "bad")])
    t = F.concat(F.col("n_nationkey").cast("string"), F.get(units, F.col("n_nationkey") % 7))
    return lenses.table(spark, d, "nation").select("n_nationkey", F.round(numbers.k8s_quantity(t), 9).alias("quantity"))


# --- alignment


@query
def q_coverage_policies(spark, d):
    return alignment.coverage(lenses.alignment_pairs(spark, d))


@query
def q_location_audit(spark, d):
    return alignment.location_audit(lenses.alignment_pairs(spark, d))


@query
def q_macro_vs_pooled(spark, d):
    return alignment.macro_and_pooled(lenses.alignment_pairs(spark, d))


@query
def q_token_savings(spark, d):
    lines = lenses.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("graph"))
    rows = lenses.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return alignment.token_savings(rows.select(F.col("o_orderpriority").alias("group"), F.col("o_totalprice").alias("raw"), "graph"))


@query
def q_better_of(spark, d):
    j = alignment.judged(lenses.alignment_pairs(spark, d))
    share = lambda c: j.groupBy("trace_id").agg(F.round(F.count_if(c).cast("double") / F.count("*").cast("double"), 4).alias("coverage"))
    return alignment.better_of(share("exact"), share("semantic").where("coverage > 0.4"))


# --- sources and reports


@query
def q_source_otlp(spark, d):
    """Events written as OTLP JSON, a file a user, and read back."""
    e = lenses.table(spark, d, "events")
    text_value = lambda c: F.struct(F.col(c).alias("stringValue"))
    kv = F.array(F.struct(F.lit("tool.name").alias("key"), text_value("event_type").alias("value")), F.struct(F.lit("input.value").alias("key"), text_value("props").alias("value")))
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    span = F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.col("event_type").alias("name"), F.lit(3).alias("kind"), nanos.alias("startTimeUnixNano"), nanos.alias("endTimeUnixNano"), F.struct(F.when(F.col("event_type") == "error", 2).otherwise(1).alias("code")).alias("status"), kv.alias("attributes"))
    files = e.groupBy("user_id").agg(F.collect_list(span).alias("spans")).select(F.col("user_id").cast("string").alias("path"), F.to_json(F.struct(F.array(F.struct(F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
    rows = traces.otlp_spans(files)
    return rows.select("trace_id", "span_id", "span_name", "span_kind", "status_code", "timestamp", "duration", F.col("attributes")["input.value"].alias("input"))


@query
def q_source_dialogue(spark, d):
    """Conversations written as dialogue histories and read back."""
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("t"))
    files = lenses.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]).alias("history")).select(F.col("conv_id").cast("string").alias("path"), F.to_json(F.struct(F.col("conv_id").cast("string").alias("question_ID"), "history")).alias("value"))
    rows = traces.dialogue_spans(files)
    return rows.select("trace_id", "span_id", "parent_span_id", "span_name", "timestamp", F.md5(F.coalesce(F.col("attributes")["output.value"], F.lit(""))).alias("output_md5"))


@query
def q_source_event_log(spark, d):
    """Events written as event logs and read back as chains."""
    e = lenses.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "tool.use").when(F.col("event_type") == "error", "chat.error").when(F.col("event_type") == "purchase", "chat.final").otherwise("other")
    item = F.struct("event_id", F.struct(F.col("event_type").alias("label"), F.col("value").alias("at_ms"), F.struct(kind.alias("event_type"), F.col("props").alias("message")).alias("payload")).alias("e"))
    files = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("events")).select(F.col("user_id").cast("string").alias("path"), F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("trace_id")).alias("meta"), "events")).alias("value"))
    rows = traces.event_log_spans(files)
    return rows.groupBy("trace_id").agg(F.count("*").alias("spans"), F.count_if(F.col("parent_span_id").isNull()).alias("roots"), F.count_if(F.col("status_code") == "Error").alias("errors"))


@query
def q_source_prometheus(spark, d):
    """Parts written as Prometheus text and read back."""
    line = F.concat(F.lit('retail_price{brand="'), "p_brand", F.lit('",key="'), F.col("p_partkey").cast("string"), F.lit('"} '), F.col("p_size").cast("string"))
    files = lenses.table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.lit("# HELP retail_price\n"), F.array_join(F.collect_list(line), "\n")).alias("value")).select(F.col("p_brand").alias("path"), "value")
    return metrics.prometheus(files).select("name", F.col("labels")["brand"].alias("brand"), F.col("labels")["key"].cast("long").alias("part"), "value")


@query
def q_digest(spark, d):
    return reports.digest(lenses.event_spans(spark, d))


@query
def q_judge_offline(spark, d):
    return reports.highest_impact(reports.root_cause_rows(reports.judged(reports.digest(lenses.event_spans(spark, d)))))


@query
def q_mermaid(spark, d):
    nodes = graph.nodes_of_spans(lenses.event_spans(spark, d))
    return reports.mermaid(nodes, graph.temporal_edges(nodes))


@query
def q_graph_json(spark, d):
    return reports.graph_json(*_graph(spark, d))


@query
def q_fault_report(spark, d):
    return reports.markdown_report(spans.fault_findings(lenses.event_spans(spark, d)))


# --- agents and further checks


def _scoped(spark, d):
    return agents.scopes(lenses.event_spans(spark, d), F.col("tool") == "signup")


@query
def q_agent_scopes(spark, d):
    return _scoped(spark, d).groupBy("trace_id", "agent_role").agg(F.count("*").alias("n"), F.max("agent_depth").alias("deepest"))


@query
def q_agent_rollup(spark, d):
    return agents.rollup(_scoped(spark, d))


@query
def q_agent_spawn_edges(spark, d):
    return agents.spawn_edges(_scoped(spark, d))


@query
def q_outcome_diagnosis(spark, d):
    return agents.outcome_diagnosis(lenses.event_spans(spark, d))


@query
def q_verdicts(spark, d):
    calls = lenses.event_spans(spark, d).withColumn("output", F.when(F.col("tool") == "click", "[]").otherwise("fine"))
    return validation.verdicts(calls, validation.violations(calls)).groupBy("trace_id", "verdict").agg(F.count("*").alias("n"))


@query
def q_date_mismatch(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = lenses.table(spark, d, "orders").join(lenses.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    calls = o.select(F.col("o_custkey").alias("trace_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("span_id"), day("o_orderdate").alias("input"), F.date_format("l_shipdate", "yyyy/M/d").alias("output"))
    return validation.date_mismatches(calls).groupBy("trace_id").agg(F.count("*").alias("n"), F.min("asked").alias("first"))


@query
def q_resource_merge(spark, d):
    rows = lenses.table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("place"), F.create_map(F.col("event_type"), F.col("props")).alias("attributes"))
    return agents.merged_resources(rows)


@query
def q_chain_normalize(spark, d):
    w = Window.partitionBy("trace_id").orderBy("pos")
    e = lenses.event_spans(spark, d)
    rows = e.select("trace_id", F.col("span_id").alias("chain"), "pos", F.col("span_id").alias("a"), F.lead("span_id").over(w).alias("b"), F.lead("span_id", 2).over(w).alias("c")).where("c is not null")
    chains = rows.select("trace_id", "chain", F.when(F.col("pos") % 3 == 0, F.col("b")).when(F.col("pos") % 3 == 1, F.col("a")).alias("root"), F.array("a", "b", "c").alias("path"))
    out = judgements.normalised_chains(chains, graph.temporal_edges(graph.nodes_of_spans(e)))
    return out.select("trace_id", "chain", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "path_valid")


@query
def q_semantic_edges(spark, d):
    return judgements.semantic_edges(validation.delivery_links(lenses.dialogue_turns(spark, d)))


@query
def q_semantic_scores(spark, d):
    e = lenses.event_spans(spark, d).withColumn("output", F.when(F.col("tool") == "click", "[]").otherwise("fine"))
    reach = e.where("pos % 2 = 0").select("trace_id", "span_id", (F.col("pos") % 10 / F.lit(10.0)).alias("probability"))
    return judgements.semantic_scores(validation.violations(e), reach)


@query
def q_missed_items(spark, d):
    return judgements.missed_and_extra(lenses.alignment_pairs(spark, d))


@query
def q_signatures(spark, d):
    t = F.col("text")
    return lenses.table(spark, d, "documents").select("doc_id", F.size(text.fact_signatures(t)).cast("long").alias("n_signatures"), F.size(text.dates(t)).cast("long").alias("n_dates"), F.size(text.required_tags(t)).cast("long").alias("n_tags"), text.final_answer(t).isNotNull().alias("answered"))


# --- semantic validation


def _steps(spark, d):
    return semantics.steps(lenses.tool_dialogues(spark, d))


@query
def q_delivery_links(spark, d):
    out = semantics.delivery_links(_steps(spark, d))
    return out.select("trace_id", "source", "consumer", "method", "state", F.array_join("matched", "|").alias("matched"), "confidence", "relation")


@query
def q_subagent_returns(spark, d):
    return semantics.subagent_returns(_steps(spark, d)).select("trace_id", "source", "consumer", F.size("matched").cast("long").alias("n_matched"), "confidence")


@query
def q_final_answers(spark, d):
    return semantics.final_answers(_steps(spark, d))


@query
def q_argument_origins(spark, d):
    return semantics.origins(_steps(spark, d))


@query
def q_tool_evidence(spark, d):
    return semantics.prior_evidence(_steps(spark, d)).select("trace_id", "span_id", F.md5("evidence").alias("evidence_md5"))


@query
def q_call_violations(spark, d):
    steps = _steps(spark, d)
    return semantics.call_violations(steps, semantics.delivery_links(steps))


@query
def q_semantic_checks(spark, d):
    out = semantics.validate(_steps(spark, d))["checks"]
    return out.select("trace_id", "span_id", "tool", "origin_id", "consumed", "verdict", F.array_join("violation_types", ",").alias("violation_types"), "reaches_final")


@query
def q_semantic_propagation(spark, d):
    return semantics.validate(_steps(spark, d))["propagation"].select("trace_id", "source", "state", "reaches_final")


@query
def q_rule_findings(spark, d):
    found = semantics.validate(_steps(spark, d))
    return semantics.rule_findings(found["violations"], found["checks"])


# --- suspicion, paths to the outcome, strategies


def _agent(spark, d):
    nodes = graph.saliency(lenses.artifact_nodes(spark, d))
    edges = graph.temporal_edges(nodes).unionByName(graph.observation_edges(nodes)).unionByName(graph.retry_edges(nodes))
    return nodes, graph.unique_edges(edges)


@query
def q_neighbourhoods(spark, d):
    nodes, edges = _agent(spark, d)
    return suspicion.neighbourhoods(nodes, graph.simple_edges(edges)).select("trace_id", "node_id", "near_failure", "is_retry", "is_bridge")


@query
def q_suspicion(spark, d):
    nodes, edges = _agent(spark, d)
    return suspicion.described(nodes, graph.simple_edges(edges)).select("trace_id", "node_id", F.round("base_score", 4).alias("base_score"), "cause_type", "tool", F.size("words").cast("long").alias("n_words"), "doubt")


@query
def q_produced_faults(spark, d):
    return suspicion.produced_faults(lenses.artifact_nodes(spark, d))


@query
def q_tool_frequencies(spark, d):
    return suspicion.tool_frequencies(lenses.artifact_nodes(spark, d))


@query
def q_diagnosis_targets(spark, d):
    return target_paths.listed(target_paths.found_paths(*_agent(spark, d), only="targets"), "targets")


@query
def q_failure_slice(spark, d):
    return target_paths.listed(target_paths.found_paths(*_agent(spark, d), only="slice"), "slice").select("trace_id", "node_id")


@query
def q_tgspe_paths(spark, d):
    found = target_paths.found_paths(*_agent(spark, d), target_paths.Limits(context=True, coverage=3))
    return target_paths.rows_of(found, "ranking").select("trace_id", "rank", "node_id", "target", "usage", "cause_type", "score", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query
def q_strategy_bm25(spark, d):
    return strategies.pruned(*_agent(spark, d), "bm25_retrieval")


@query
def q_strategy_window(spark, d):
    return strategies.pruned(*_agent(spark, d), "temporal_window", most=20, room=600)


@query
def q_strategies(spark, d):
    nodes, edges = _agent(spark, d)
    return strategies.all_pruned(nodes, edges).groupBy("strategy").agg(F.count("*").alias("n_nodes"), F.count_distinct("trace_id").alias("n_traces"))


@query
def q_subgraph_summary(spark, d):
    nodes, edges = _agent(spark, d)
    return selection.subgraph_summary(nodes, edges, nodes.where("ord % 3 = 0"))


@query
def q_packed_slice(spark, d):
    nodes, edges = _agent(spark, d)
    return selection.packed_slice(nodes, edges).select("trace_id", "node_id", "hops")


@query
def q_path_edges(spark, d):
    nodes, edges = _agent(spark, d)
    w = Window.partitionBy("trace_id").orderBy("ord")
    paths = nodes.select("trace_id", "ord", F.array("node_id", F.lead("node_id").over(w), F.lead("node_id", 2).over(w)).alias("path")).where("ord % 5 = 0 and path[2] is not null")
    return selection.on_paths(edges, paths).select("trace_id", "source", "target", "edge_type")


# --- digests, anchors and packs


@query
def q_graph_signals(spark, d):
    nodes, edges = _agent(spark, d)
    return digests.signals(nodes, edges.unionByName(_thoughts(nodes)))


def _thoughts(nodes):
    w = Window.partitionBy("trace_id").orderBy("ord")
    rows = nodes.withColumn("target", F.lead("node_id", 2).over(w)).where("ord % 4 != 1 and target is not null")
    return rows.select("trace_id", F.col("node_id").alias("source"), "target", F.lit("Cognitive").alias("edge_type"), F.lit(0.5).alias("score"))


@query
def q_salient_projection(spark, d):
    out = digests.projected(*_agent(spark, d), "pure", 10)
    return out.withColumn("content_flags", F.array_join("content_flags", ","))


@query
def q_graph_digest(spark, d):
    nodes, edges = _agent(spark, d)
    j = digests.graph_digest(nodes, edges.unionByName(_thoughts(nodes)))
    at = lambda p: F.get_json_object("digest", p)
    return j.select("trace_id", at("$.stats.n_nodes").cast("long").alias("n_nodes"), at("$.signals.retry_edges").cast("long").alias("retry_edges"), at("$.top_salient_nodes[0].node_id").cast("long").alias("top_node"), at("$.top_cognitive_edges[0].source").cast("long").alias("top_edge"))


def _chains(spark, d):
    nodes = lenses.artifact_nodes(spark, d)
    w = Window.partitionBy("trace_id").orderBy("ord")
    name = F.concat(F.left("type", F.lit(1)), F.lit("_"), F.col("node_id").cast("string"))
    rows = nodes.select("trace_id", "ord", name.alias("a"), F.lead(name).over(w).alias("b"), F.lead(name, 2).over(w).alias("c")).where("ord % 6 = 1 and c is not null")
    cause = F.get(F.array(*[F.lit(x) for x in ("tool_or_execution_failure", "wrong_action_or_tool_choice", "final_answer_symptom", "unsupported_or_invalid_reasoning", "other")]), (F.col("ord") % 5).cast("int"))
    chains = rows.select("trace_id", F.col("ord").alias("chain"), F.col("a").alias("origin"), F.lit(None).cast("string").alias("root"), F.col("b").alias("usage"), F.col("c").alias("final"), F.array("a", "b", "c").alias("path"), cause.alias("cause_type"), F.lit("plain").alias("said"))
    causes = rows.select("trace_id", F.col("ord").alias("item"), F.when(F.col("ord") % 4 == 1, F.col("b")).otherwise(F.concat(F.lit("span"), F.col("ord").cast("string"))).alias("location"), F.lit("x").alias("said"))
    named = nodes.select("trace_id", name.alias("node_id"), F.concat(F.lit("S"), F.col("node_id").cast("string")).alias("span_id"))
    return causes, chains, named


@query
def q_relocated_causes(spark, d):
    return digests.relocated(*_chains(spark, d))


@query
def q_compact_chains(spark, d):
    nodes, edges = _agent(spark, d)
    ranked = nodes.where("ord % 5 = 0").select("trace_id", (F.col("ord") / 5).cast("int").alias("rank"), "node_id", F.col("node_id").alias("usage"), F.col("node_id").alias("target"))
    return digests.compact_chains(ranked, nodes, "pure").select("trace_id", "rank", "node_id", "origin_type", "final_type", F.col("usage_evidence_chars").cast("long").alias("usage_evidence_chars"))


@query
def q_prompt_pack(spark, d):
    nodes, edges = _agent(spark, d)
    j = digests.prompt_pack(nodes, edges, nodes.where("ord % 2 = 0"), "pure")
    at = lambda p: F.get_json_object("pack", p)
    return j.select("trace_id", at("$.node_count").cast("long").alias("node_count"), at("$.edge_count").cast("long").alias("edge_count"), at("$.nodes[0].content_chars").cast("long").alias("first_chars"))


@query
def q_graph_report(spark, d):
    return digests.graph_report(*_agent(spark, d))


@query
def q_subgraph_json(spark, d):
    nodes, edges = _agent(spark, d)
    j = digests.subgraph_json(nodes, edges, nodes.where("ord <= 9"), "first_nine")
    at = lambda p: F.get_json_object("graph", p)
    return j.select("trace_id", "strategy", at("$.evaluation.node_count").cast("long").alias("node_count"), at("$.graph.summary.total_edges").cast("long").alias("total_edges"))


@query
def q_view_payload(spark, d):
    nodes, edges = _agent(spark, d)
    spans_ = lenses.event_spans(spark, d).select("trace_id", "span_id", "parent_id", F.when(F.col("tool") == "click", "tool call").when(F.col("tool") == "signup", "agent").otherwise("Step 1").alias("name"), "pos", "status")
    j = digests.view_payload(nodes, edges, spans_)
    at = lambda p: F.get_json_object("payload", p)
    return j.select("trace_id", at("$.nodes[0].label").alias("label"), at("$.spans[0].component").alias("component"), at("$.components[0].n").cast("long").alias("n_first"))


@query
def q_batch_summary(spark, d):
    rows = lenses.alignment_pairs(spark, d).select("human_impact", F.when(F.col("item") % 7 == 0, "n/a").otherwise((F.col("item") % 10).cast("string")).alias("score"))
    return digests.batch_summary(rows, "human_impact", ["score"], F.col("score") != "n/a")


# --- nodes by the names of spans, data sets and stores


def _named(spark, d):
    rows = lenses.tool_dialogues(spark, d)
    return rows.withColumn("name", F.when(F.col("name") == "chat", "LiteLLMModel.__call__").otherwise(F.col("name"))).withColumn("status_message", F.lit(""))


@query
def q_extracted_nodes(spark, d):
    rows = _named(spark, d)
    out = extraction.nodes(rows, semantics.final_answers(semantics.steps(rows)))
    return out.select("trace_id", "node_id", "ord", "type", F.md5("content").alias("content_md5"), "span_id")


@query
def q_suspicious_spans(spark, d):
    given = F.when(F.col("tool") == "signup", '{"kwargs": {"": ""}}').otherwise("{}")
    rows = lenses.event_spans(spark, d).withColumn("attributes", F.create_map(F.lit("input.value"), given, F.lit("output.value"), F.col("tool"))).withColumn("name", F.lit("Step 1")).withColumn("status_message", F.lit(""))
    return extraction.suspicious_spans(rows).select("trace_id", "span_id", "kind")


@query
def q_dedup_provenance(spark, d):
    nodes = lenses.artifact_nodes(spark, d).withColumn("agent_id", F.concat(F.lit("a"), (F.col("ord") % 2).cast("string")))
    return graph.deduplicated(nodes).select("trace_id", "node_id", "type", "occurrences", F.array_join(F.col("source_steps").cast("array<string>"), ",").alias("source_steps"))


@query
def q_dataset_rows(spark, d):
    train = lenses.table(spark, d, "benchmark").select(F.when(F.col("item_id") % 3 != 0, F.col("item_id").cast("string")).otherwise("").alias("id"), F.col("text").alias("annotation"), F.col("item_id").alias("k"))
    test = lenses.table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_regionkey").cast("long").alias("k"))
    rows = datasets.splits({"train": train, "test": test}, "k")
    return rows.select("split", "idx", datasets.sample_id(rows, F.col("idx")).alias("sample_id"), F.md5(datasets.annotation_column(rows)).alias("annotation_md5"))


@query
def q_annotations(spark, d):
    n = lenses.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    files = n.where("n_nationkey % 3 < 2").select(F.concat(F.lit("/notes/"), k, F.lit(".json")).alias("path"), F.when(F.col("n_nationkey") % 3 == 0, '{"errors":[]}').otherwise("{broken").alias("value"))
    return datasets.annotated(n.select(k.alias("trace_id")), files).select("trace_id", "status")


@query
def q_graph_files(spark, d):
    n = lenses.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/g/local_"), k, F.lit("_graph.json"))).otherwise(F.concat(F.lit("/g/a-"), k, F.lit(".json")))
    files = n.where("n_nationkey % 3 < 2").select(name.alias("path"), F.lit("{}").alias("value"))
    return datasets.graph_of(n.select(k.alias("trace_id")), files).select("trace_id", "file")


@query
def q_graph_choice(spark, d):
    n = lenses.table(spark, d, "nation").select(F.col("n_nationkey").alias("trace_id"))
    g = lambda p: n.select("trace_id", F.concat(F.lit(p), F.col("trace_id").cast("string")).alias("graph"))
    return datasets.first_graph(g("f"), g("p").where("trace_id % 2 = 0"), g("s").where("trace_id % 4 = 0"))


def _payloads(spark, d):
    e = lenses.table(spark, d, "events")
    span = F.to_json(F.struct(F.lpad(F.col("user_id").cast("string"), 32, "0").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.col("event_type").alias("name")))
    # a payload for every hundred users: one of all events would be one string in one task, and beyond 2 GB none at all
    rows = e.groupBy(F.call_function("div", F.col("user_id"), F.lit(100)).alias("k")).agg(F.array_join(F.collect_list(span), ",").alias("spans"))
    return rows.select(F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[]},"scopeSpans":[{"scope":{"name":"s"},"spans":['), "spans", F.lit("]}]}]}")).alias("value"))


@query
def q_payload_split(spark, d):
    out = datasets.by_trace(_payloads(spark, d))
    n = F.size(F.from_json(F.get_json_object("payload", "$.resourceSpans[0].scopeSpans[0].spans"), "array<string>"))
    return out.select("trace_id", "n_spans", n.cast("long").alias("spans_in_payload"))


@query
def q_payload_manifest(spark, d):
    return datasets.manifest(datasets.by_trace(_payloads(spark, d)))


# --- evaluation and judging


def _scored(spark, d):
    pairs = lenses.alignment_pairs(spark, d)
    told = pairs.withColumn("chain_aware_location_match", F.when(F.col("item") % 3 == 0, "yes").otherwise("no")).withColumn("result_match", F.when(F.col("item") % 4 == 3, "0").otherwise("true"))
    both = told.withColumn("source", F.when(F.col("item") % 2 == 0, "raw").otherwise("graph"))
    totals = pairs.groupBy("trace_id", F.col("human_impact").alias("impact")).agg(F.count("*").alias("human_total"))
    return evaluation.normalised_pairs(both), totals


@query
def q_normalised_pairs(spark, d):
    return _scored(spark, d)[0].select("trace_id", "item", "source", "semantic", "exact", "chain_aware", "strict")


@query
def q_trace_coverage(spark, d):
    return evaluation.trace_coverage(*_scored(spark, d))


@query
def q_global_rates(spark, d):
    return evaluation.global_rates(evaluation.trace_coverage(*_scored(spark, d)))


@query
def q_evaluated(spark, d):
    n = lenses.table(spark, d, "nation")
    made = n.where("n_nationkey % 5 != 0").select(F.col("n_nationkey").alias("trace_id"), F.lit("raw").alias("source"), (F.col("n_nationkey") % 3 != 0).alias("ok"))
    return evaluation.evaluated(made, n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("trace_id")))


@query
def q_matching_errors(spark, d):
    n = lenses.table(spark, d, "nation")
    causes = n.select(F.col("n_regionkey").alias("trace_id"), F.col("n_nationkey").alias("item"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("s"), (F.col("n_nationkey") % 6).cast("string"))).otherwise("unknown").alias("location"), F.when(F.col("n_nationkey") % 3 == 0, "Tool").otherwise("plan").alias("module"))
    errors = n.select(F.col("n_regionkey").alias("trace_id"), F.col("n_nationkey").alias("place"), F.concat(F.lit("s"), (F.col("n_nationkey") % 6).cast("string")).alias("location"), F.when(F.col("n_nationkey") % 4 == 0, "tool").otherwise("other").alias("module"), F.col("n_name").alias("category"))
    return evaluation.matching_errors(causes, errors).select("trace_id", "item", "error_place", "matched_by")


@query
def q_audit_rows(spark, d):
    return evaluation.audit_rows(lenses.alignment_pairs(spark, d)).select("trace_id", "item", "relation")


@query
def q_token_limits(spark, d):
    rows = lenses.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 200_000).alias("tokens"))
    first = evaluation.input_limit(F.when(F.col("o_orderkey") % 2 == 0, 60_000).otherwise(0), F.col("o_orderkey") % 500)
    return rows.select("o_orderkey", first.cast("long").alias("first"), F.array_join(evaluation.retry_limits(first, F.col("tokens"), 4).cast("array<string>"), ",").alias("limits"))


def _asked(spark, d):
    views = {s: lenses.dialogue_turns(spark, d).where(c).select(F.concat("trace_id", F.lit("-"), "step").alias("trace_id"), F.concat(F.lit("w"), F.col("step").cast("string"), F.lit(" seen")).alias("body")) for s, c in (("raw", "step >= 0"), ("graph", "step % 2 = 0"), ("pure_graph", "step % 3 = 0"))}
    return views


@query
def q_judge_batch(spark, d):
    views = _asked(spark, d)
    done = views["raw"].where("trace_id like '%-0'").select(F.col("trace_id").cast("string").alias("trace_id"), F.lit("raw").alias("source"))
    out = judging.batch(views, done)
    return out.select("trace_id", "source", "ok", F.get_json_object("judgement", "$.root_causes[0].location").alias("location"), "tries")


@query
def q_judge_usage(spark, d):
    return judging.usage(judging.batch(_asked(spark, d)).withColumn("prompt_tokens", F.when(F.col("source") == "raw", 10).when(F.col("source") == "graph", 4).otherwise(1).cast("long"))).select("source", "n", "n_ok", "prompt_tokens", "saving")


@query
def q_judge_checks(spark, d):
    n = lenses.table(spark, d, "nation")
    told = n.select(F.col("n_nationkey").cast("string").alias("trace_id"), F.lit("raw").alias("source"), (F.col("n_nationkey") % 5 != 0).alias("ok"), F.when(F.col("n_nationkey") % 2 == 0, '{"coverage_checks":{"planning":"FAIL","format":"odd"}}').otherwise("{}").alias("judgement"))
    return judging.checked(told)


@query
def q_diagnosis(spark, d):
    n = lenses.table(spark, d, "nation").select(F.col("n_nationkey").alias("trace_id"))
    causes = n.where("trace_id % 3 = 0").select("trace_id", F.lit(1).alias("place"), F.concat(F.lit("s"), F.col("trace_id").cast("string")).alias("location"), F.lit("said").alias("reason"))
    chains = n.where("trace_id % 2 = 0").select("trace_id", F.lit(1).alias("rank"), (F.col("trace_id") + 100).alias("node_id"), F.lit("other").alias("cause_type"))
    findings = n.select("trace_id", F.explode(F.array(F.struct(F.lit("F4").alias("fault_id"), F.lit(0.98).alias("confidence")), F.struct(F.lit("F3").alias("fault_id"), F.lit(0.78).alias("confidence")))).alias("f")).select("trace_id", "f.*")
    return judging.diagnosis(causes, chains, findings)


# --- layers and texts


@query
def q_application_layer(spark, d):
    nodes, edges = _agent(spark, d)
    rows = lenses.event_spans(spark, d).select("trace_id", F.when(F.col("tool") == "signup", "LiteLLMModel.__call__").otherwise("SearchTool").alias("name"), F.when(F.col("tool") == "click", F.col("tool")).alias("tool"), "status")
    return monitoring.application(rows, nodes, edges)


@query
def q_accelerator_flags(spark, d):
    return monitoring.accelerator_flags(lenses.metric_samples(spark, d)).select("pod", "device_count", "utilization_max", "temperature_max", "error_devices", F.array_join("flags", ",").alias("flags"))


@query
def q_scoped_samples(spark, d):
    e = lenses.table(spark, d, "events")
    labels = F.create_map(F.lit("pod"), F.when(F.col("event_type") == "click", F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).otherwise(""), F.lit("gpu"), (F.col("user_id") % 10).cast("string"))
    samples = e.select(labels.alias("labels"), F.lit("m").alias("name"), "value", "event_id")
    pods = spark.createDataFrame([(f"p{k}", None) for k in range(4)] + [("gone", "x")], "pod string, namespace string")
    return monitoring.scoped_samples(samples, pods).groupBy("asked", "scope").agg(F.count("event_id").alias("n"))


@query
def q_host_status(spark, d):
    probes = lenses.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("system_id"), (F.col("p_size") * 2).cast("double").alias("cpu"), (F.col("p_partkey") % 100).cast("double").alias("memory"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") + 50.0).alias("disk"))
    return monitoring.host_status(probes)


@query
def q_text_parts(spark, d):
    t = F.col("text")
    first = F.left(t, F.lit(300))
    listed = F.concat_ws(",", F.lit(" a"), F.col("lang"), F.lit("a"), F.lit(""))
    return lenses.table(spark, d, "documents").select(
        "doc_id", F.size(text.lexical_tokens(t)).cast("long").alias("n_lexical"), F.array_join(text.path_parts(F.concat(F.col("lang"), F.lit(" -> "), F.col("source"), F.lit(", E_1"))), "|").alias("path"), F.array_join(text.id_list(listed), "|").alias("ids"),
        F.md5(text.dumped(F.struct("doc_id", "lang"), 20)).alias("dumped"), F.md5(text.task_of_input(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("source").alias("task")))).otherwise(first))).alias("task"), F.length(text.token_cut(first, 40)).alias("cut_chars"),
        digests.type_of_id(F.concat(F.upper(F.left("lang", F.lit(1))), F.lit("_1"))).alias("kind"), digests.input_mode(F.col("doc_id"), "digest", F.array(F.lit("3"), F.lit("5"))).alias("mode"), F.size(text.task_terms(F.concat(F.lit('say "'), F.col("lang"), F.lit('x" now')))).cast("long").alias("n_terms"),
        extraction.tool_error_text(F.when(F.col("doc_id") % 2 == 0, "Unset").otherwise("Ok"), F.lit("it FAILED")).alias("tool_error"), F.coalesce(extraction.argument_fault(F.when(F.col("doc_id") % 3 == 0, '{"kwargs":{"":""}}').otherwise('{"kwargs":{"a":"1"}}'), F.lit("{}")), F.lit("")).alias("fault"),
    )


# --- scopes, resources, uploads, exported graphs


@query
def q_inferred_scopes(spark, d):
    e = lenses.event_spans(spark, d)
    run, spawn = (F.col("tool") == "signup") & (F.col("span_id") % 2 == 0), (F.col("tool") == "signup") & (F.col("span_id") % 2 == 1)
    rows = e.select("trace_id", "span_id", "parent_id", "pos", F.when(run, "CodeAgent.run").otherwise("step").alias("name"), F.when(spawn, "spawn_agent").otherwise("").alias("tool"), F.col("input").alias("task"))
    out = agents.inferred_scopes(rows)
    return out.select("trace_id", "span_id", "agent_id", "agent_role", "agent_depth", "parent_agent_id", "spawn_span_id")


@query
def q_virtualization(spark, d):
    k = F.col("user_id") % 4
    key = F.when(k == 0, "k8s.pod.name").when(k == 1, "cloud.region").when(k == 2, "host.name").otherwise("other")
    rows = lenses.table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("place"), F.create_map(key, F.col("event_type"), F.lit("service.name"), F.when(k < 2, F.col("event_type")).otherwise("")).alias("attributes"))
    return agents.virtualization(rows)


@query
def q_uploads(spark, d):
    n = lenses.table(spark, d, "nation")
    files = n.select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("path"), F.when(F.col("n_nationkey") % 3 == 0, "{}").when(F.col("n_nationkey") % 3 == 1, "{oops").otherwise(" ").alias("value"))
    return datasets.uploaded(files, 20).select("path", "ok", "error")


@query
def q_exported_graphs(spark, d):
    nodes, edges = _graph(spark, d)
    files = reports.graph_json(nodes, edges).withColumnRenamed("graph", "value")
    n, e = datasets.graph_tables(files)
    back = n.groupBy("trace_id").agg(F.count("*").alias("nodes"), F.max_by("node_id", "ord").alias("last"))
    return back.join(e.groupBy("trace_id").agg(F.count("*").alias("edges"), F.round(F.sum("score"), 4).alias("score")), "trace_id", "left")


@query
def q_diagnostic_report(spark, d):
    n = lenses.table(spark, d, "nation").select(F.col("n_nationkey").alias("trace_id"))
    causes = n.where("trace_id % 2 = 0").select("trace_id", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.concat(F.lit(f"s{k}-"), F.col("trace_id").cast("string")).alias("location"), F.lit("a|b").alias("reason"), F.lit(i).alias("impact")) for k, i in ((1, "LOW"), (2, "HIGH"))])).alias("c")).select("trace_id", "c.*")
    chains = n.where("trace_id % 3 = 0").select("trace_id", F.lit(1).alias("rank"), F.array(F.col("trace_id"), F.col("trace_id") + 1).alias("path"), F.lit(0.5).alias("score"))
    findings = n.where("trace_id % 5 = 0").select("trace_id", F.lit("F4").alias("fault_id"), F.lit("Execution crash").alias("name"), F.lit(0.98).alias("confidence"))
    return reports.diagnostic_markdown(findings, causes, chains)
