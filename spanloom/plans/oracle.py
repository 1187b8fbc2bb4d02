"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

ES = """es AS (
  SELECT user_id AS trace_id, event_id AS span_id, ts, event_type AS tool, props AS input, value AS duration,
         'Tool: ' || event_type || ' | Args: ' || props AS content,
         max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos,
         CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status, event_type = 'purchase' AS is_final
  FROM events)"""
TREE = """tree AS (
  SELECT 'R' || r_regionkey AS span_id, NULL AS parent_id, r_name AS input FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, '' FROM orders
  UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'O' || l_orderkey, NULL FROM lineitem)"""
UP = """up AS (
  SELECT span_id, parent_id AS ancestor_id, 1 AS dist FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT up.span_id, t.parent_id, up.dist + 1 FROM up JOIN tree t ON t.span_id = up.ancestor_id WHERE t.parent_id IS NOT NULL)"""
DIALOGUE = """turns AS (
  SELECT conv_id AS trace_id, CAST(turn AS INTEGER) AS step, role, text AS content,
         CASE WHEN role IN ('system', 'human') THEN 'Intent'
              WHEN regexp_matches(lower(text), 'final answer|in conclusion|the answer is') THEN 'Conclusion'
              WHEN regexp_matches(lower(text), '\\bplan\\b|next step|i will|let me') THEN 'Planning' ELSE 'Fact' END AS type
  FROM conversations), dn AS (
  SELECT *, substr(type, 1, 1) || '_' || (row_number() OVER (PARTITION BY trace_id, type ORDER BY step) - 1) AS node_id,
         CAST(row_number() OVER (PARTITION BY trace_id ORDER BY step) AS INTEGER) AS ord FROM turns)"""
CORPUS = """cn AS (
  SELECT source AS trace_id, doc_id AS node_id, CAST(row_number() OVER w AS INTEGER) AS ord, text AS content,
         CASE WHEN lead(doc_id) OVER w IS NULL THEN 'Conclusion' WHEN lang = 'en' THEN 'Fact' WHEN lang = 'de' THEN 'Action' WHEN lang = 'es' THEN 'Planning' ELSE 'Error' END AS type
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""
STOP = "['the','and','for','with','that','this','from','are','was','were','has','have','had','not','you','your','will','would','can','could','should','into','about','then','than','them','they','their','there']"
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(content, '')), '[a-zA-Z0-9_\\-]{{3,}}'), lambda x: NOT list_contains({STOP}, x))"
WEIGHT = "CASE type WHEN 'Error' THEN 5.2 WHEN 'Conclusion' THEN 5.0 WHEN 'Intent' THEN 4.0 WHEN 'Fact' THEN 3.2 WHEN 'Action' THEN 3.0 WHEN 'Planning' THEN 2.5 ELSE 1.0 END::DOUBLE"
BONUS = "CASE type WHEN 'Conclusion' THEN 5.0 WHEN 'Error' THEN 4.8 WHEN 'Intent' THEN 3.5 WHEN 'Fact' THEN 3.2 WHEN 'Action' THEN 2.8 WHEN 'Planning' THEN 2.4 ELSE 1.0 END::DOUBLE"


def salient(source: str, name: str) -> str:
    """A view of nodes with saliency."""
    return f"{name} AS (SELECT *, round({WEIGHT} + CASE WHEN regexp_matches(lower(content), 'final answer|final_answer\\(') THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(lower(content), 'observation|execution logs') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN regexp_matches(lower(content), 'error|failed') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END + 0.4::DOUBLE * row_number() OVER (PARTITION BY trace_id ORDER BY ord) / count(*) OVER (PARTITION BY trace_id), 4) AS saliency FROM {source})"


NODES = """gn AS (SELECT trace_id, span_id AS node_id, pos AS ord, content, span_id, parent_id, tool,
  CASE WHEN status = 'Error' THEN 'Error' WHEN is_final THEN 'Conclusion' WHEN tool = 'signup' THEN 'Intent' WHEN tool = 'click' THEN 'Action' ELSE 'Fact' END AS type FROM es)"""
TEMPORAL = "SELECT trace_id, node_id AS source, lead(node_id) OVER (PARTITION BY trace_id ORDER BY ord) AS target, 'Temporal' AS edge_type, 1.0::DOUBLE AS score FROM gn QUALIFY target IS NOT NULL"
CALL = "SELECT c.trace_id, p.node_id AS source, c.node_id AS target, 'Call' AS edge_type, 1.0::DOUBLE AS score FROM gn c JOIN gn p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id"
OBSERVE = """SELECT a.trace_id, a.node_id AS source, arg_min(b.node_id, b.ord) AS target, 'Observation' AS edge_type, 0.95::DOUBLE AS score
  FROM gn a JOIN gn b ON b.trace_id = a.trace_id AND b.ord BETWEEN a.ord + 1 AND a.ord + 3 AND b.type IN ('Fact', 'Error') AND (b.parent_id IS NOT DISTINCT FROM a.parent_id OR b.parent_id IS NULL)
  WHERE a.type = 'Action' GROUP BY a.trace_id, a.node_id"""
RETRY = "SELECT trace_id, lag(node_id) OVER (PARTITION BY trace_id, tool ORDER BY ord) AS source, node_id AS target, 'Retry' AS edge_type, 0.9::DOUBLE AS score FROM gn QUALIFY source IS NOT NULL"
EDGES = f"te AS ({TEMPORAL}), ce AS ({CALL}), oe AS ({OBSERVE}), re AS ({RETRY}), ge AS (SELECT * FROM te UNION ALL SELECT * FROM ce UNION ALL SELECT * FROM oe UNION ALL SELECT * FROM re)"
GRAPH = f"{ES}, {NODES}, {EDGES}"
REPEATED = """rep AS (SELECT trace_id, tool, input, count(*) AS attempts, count(*) FILTER (status = 'Error') AS errors, min(pos) AS first_pos
  FROM es GROUP BY trace_id, tool, input HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY attempts DESC, first_pos) = 1)"""
BEFORE_FINAL = """bf AS (SELECT trace_id, span_id, pos, final_pos, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY pos DESC) AS INTEGER) AS back
  FROM (SELECT *, max(CASE WHEN is_final THEN pos END) OVER (PARTITION BY trace_id) AS final_pos FROM es) WHERE status = 'Error' AND pos < final_pos QUALIFY back <= 3)"""
SHARED = """sp AS (SELECT trace_id, parent_id, count(*) AS errors, min(pos) AS first_pos FROM es WHERE status = 'Error' AND parent_id IS NOT NULL
  GROUP BY trace_id, parent_id HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY errors DESC, first_pos) = 1)"""
MONITOR = """me AS (SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS system_id, value AS measurement,
  CASE event_type WHEN 'view' THEN 'hardware' WHEN 'signup' THEN 'virtualization' WHEN 'click' THEN 'communication' WHEN 'purchase' THEN 'application' ELSE 'invalid' END AS layer FROM events),
  ok AS (SELECT * FROM me WHERE layer != 'invalid')"""
LATENCY = """lat AS (SELECT *, row_number() OVER (PARTITION BY trace_id, tool ORDER BY pos) > 1 AS again FROM es)"""
PAIRS = """pr AS (SELECT source AS trace_id, doc_id AS item,
    CASE WHEN quality = 0 AND toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS human_impact,
    CASE WHEN n_chars < 800 THEN 'HIGH' WHEN n_chars < 2500 THEN 'MEDIUM' ELSE 'LOW' END AS auto_impact,
    doc_id AS h, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END AS a
  FROM labels JOIN documents USING (doc_id)), jd AS (
  SELECT *, human_impact = auto_impact AS semantic, coalesce(h = a, false) AS exact, coalesce(abs(h - a) <= 1, false) AS chain_aware FROM pr), ju AS (
  SELECT *, semantic AND exact AS strict FROM jd)"""
TF = f"""tok AS (SELECT trace_id, node_id, {TOKENS} AS w FROM cn), len AS (SELECT trace_id, node_id, len(w) AS len FROM tok),
  tf AS (SELECT trace_id, node_id, term, count(*) AS tf FROM (SELECT trace_id, node_id, unnest(w) AS term FROM tok) GROUP BY ALL),
  df AS (SELECT trace_id, term, count(*) AS df FROM tf GROUP BY ALL),
  ft AS (SELECT unnest(['error', 'failure', 'failed', 'invalid', 'incorrect', 'wrong', 'exception', 'timeout', 'missing', 'unsupported', 'contradiction', 'retry', 'root', 'cause']) AS term),
  q AS (SELECT trace_id, term, CAST(sum(qtf) AS BIGINT) AS qtf FROM (SELECT trace_id, term, tf AS qtf FROM tf JOIN cn USING (trace_id, node_id) WHERE cn.type = 'Conclusion' UNION ALL SELECT trace_id, term, 1 FROM (SELECT DISTINCT trace_id FROM cn) CROSS JOIN ft) GROUP BY ALL)"""
SAFE_IDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-f]{16}|[ipafce]_[0-9]+'))"
BUDGET = f"""RECURSIVE {CORPUS}, {salient('cn', 'sn')}, rk AS (
    SELECT trace_id, node_id, length(content) AS size, row_number() OVER (PARTITION BY trace_id ORDER BY saliency DESC, CAST(node_id AS VARCHAR) DESC) AS r FROM sn),
  pack AS (
    SELECT trace_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS item, 0::BIGINT AS size FROM (SELECT DISTINCT trace_id FROM cn)
    UNION ALL
    SELECT p.trace_id, k.r, CASE WHEN p.n < 40 AND p.used + k.size <= 18000 THEN p.used + k.size ELSE p.used END,
           CASE WHEN p.n < 40 AND p.used + k.size <= 18000 THEN p.n + 1 ELSE p.n END,
           CASE WHEN p.n < 40 AND p.used + k.size <= 18000 THEN k.node_id END, k.size
    FROM pack p JOIN rk k ON k.trace_id = p.trace_id AND k.r = p.r + 1),
  kept AS (SELECT trace_id, item, size, n AS place FROM pack WHERE item IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "q_fault_findings_union": f"""WITH {ES}, {REPEATED}, {BEFORE_FINAL}, {SHARED}, f AS (
      SELECT trace_id, 'F3' AS fault_id, attempts AS n_evidence FROM rep
      UNION ALL SELECT trace_id, 'F10', errors FROM rep WHERE errors >= 2
      UNION ALL SELECT trace_id, 'F11', count(*) FROM bf GROUP BY trace_id
      UNION ALL SELECT trace_id, 'F12', errors FROM sp
      UNION ALL SELECT trace_id, 'F4', count(*) FROM es WHERE status = 'Error' GROUP BY trace_id),
      c(fault_id, name, category, confidence) AS (VALUES ('F3', 'Action loop', 'planning', 0.78::DOUBLE), ('F10', 'Failed retry', 'recovery', 0.84::DOUBLE),
        ('F11', 'Ignored error', 'recovery', 0.72::DOUBLE), ('F12', 'Cascading failure', 'system', 0.76::DOUBLE), ('F4', 'Execution crash', 'tool', 0.98::DOUBLE))
      SELECT trace_id, fault_id, name, category, confidence, n_evidence FROM f JOIN c USING (fault_id)""",
    "q_span_flatten_order": f"WITH {ES} SELECT trace_id, span_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, pos) AS INTEGER) AS seq FROM es",
    "q_parent_join_roots": f"WITH {TREE} SELECT substr(c.span_id, 1, 1) AS level, count(*) AS n_spans, count(*) FILTER (p.span_id IS NULL) AS n_roots FROM tree c LEFT JOIN tree p ON p.span_id = c.parent_id GROUP BY 1",
    "q_ancestor_closure": f"WITH RECURSIVE {TREE}, {UP} SELECT substr(ancestor_id, 1, 1) AS level, dist, count(*) AS n, count(DISTINCT ancestor_id) AS ancestors FROM up GROUP BY ALL",
    "q_nearest_ancestor_task": f"WITH RECURSIVE {TREE}, {UP}, n AS (SELECT up.span_id, arg_min(t.input, up.dist) AS task, min(up.dist) AS dist FROM up JOIN tree t ON t.span_id = up.ancestor_id WHERE trim(t.input) != '' GROUP BY up.span_id) SELECT task, count(*) AS n, max(dist) AS max_dist FROM n GROUP BY task",
    "q_descendants": f"WITH RECURSIVE {TREE}, {UP} SELECT ancestor_id AS span_id, count(*) AS descendants FROM up GROUP BY 1",
    "q_status_decode": f"WITH {ES} SELECT trace_id, span_id, status != 'Error' AS transport_success, NOT regexp_matches(lower(content), 'error|failed|failure|exception|timeout|timed out|traceback') AS business_success, status = 'Error' OR regexp_matches(lower(content), 'error|failed|failure|exception|timeout|timed out|traceback') AS is_error FROM es",
    "q_violations": f"""WITH {ES}, v AS (
      SELECT trace_id, 'missing_required_argument' AS violation_type, 'HIGH' AS severity FROM es WHERE tool = 'signup'
      UNION ALL SELECT trace_id, 'tool_execution_failure', 'HIGH' FROM es WHERE status = 'Error'
      UNION ALL SELECT trace_id, 'empty_tool_result', 'MEDIUM' FROM es WHERE tool = 'click'
      UNION ALL SELECT trace_id, 'http_failure', 'HIGH' FROM es WHERE tool = 'view')
      SELECT trace_id, violation_type, severity, count(*) AS n FROM v GROUP BY ALL""",
    "q_action_loop": f"WITH {ES}, {REPEATED} SELECT * FROM rep",
    "q_failed_retry": f"WITH {ES}, {REPEATED} SELECT * FROM rep WHERE errors >= 2",
    "q_error_before_final": f"WITH {ES}, {BEFORE_FINAL} SELECT * FROM bf",
    "q_shared_parent_cascade": f"WITH {ES}, {SHARED} SELECT * FROM sp",
    "q_temporal_edges": f"WITH {ES}, {NODES} {TEMPORAL}",
    "q_retry_edges": f"WITH {ES}, {NODES} {RETRY}",
    "q_observation_edges": f"WITH {ES}, {NODES} {OBSERVE}",
    "q_call_edges": f"WITH {ES}, {NODES} {CALL}",
    "q_dialogue_reply_edges": f"WITH {DIALOGUE} SELECT trace_id, CASE WHEN step - lag(step) OVER w = 1 THEN lag(node_id) OVER w END AS source, node_id AS target, 'reasoning_dependency' AS edge_type, 0.85::DOUBLE AS score FROM dn WINDOW w AS (PARTITION BY trace_id ORDER BY step) QUALIFY source IS NOT NULL",
    "q_node_ids": f"WITH {DIALOGUE} SELECT trace_id, node_id, ord, type FROM dn",
    "q_node_dedup": f"WITH {CORPUS}, k AS (SELECT *, left(regexp_replace(regexp_replace(lower(content), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 800) AS fp FROM cn) SELECT trace_id, node_id, ord, type, count(*) OVER (PARTITION BY trace_id, type, fp) AS occurrences FROM k QUALIFY row_number() OVER (PARTITION BY trace_id, type, fp ORDER BY ord) = 1",
    "q_saliency": f"WITH {CORPUS}, {salient('cn', 'sn')} SELECT trace_id, node_id, saliency FROM sn",
    "q_cognitive_topk": f"""WITH {CORPUS}, n AS (SELECT trace_id, node_id, ord, type, list_distinct({TOKENS}) AS w FROM cn), p AS (
      SELECT a.trace_id, a.node_id AS source, b.node_id AS target, a.ord AS so, b.ord AS tord, a.type AS st, b.type AS tt,
             round(CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) ELSE 0.0 END + CASE WHEN a.type = 'Error' THEN 0.1::DOUBLE ELSE 0.0 END, 6) AS score
      FROM n a JOIN n b ON a.trace_id = b.trace_id AND a.ord < b.ord), t AS (
      SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY trace_id, target ORDER BY score DESC, so) <= 3), u AS (
      SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, tord, so) <= 24), z AS (
      SELECT *, CASE WHEN st = 'Error' AND tt IN ('Action', 'Conclusion', 'Planning') THEN 0.04::DOUBLE ELSE 0.06::DOUBLE END AS least FROM u)
      SELECT trace_id, source, target, score, CASE WHEN score >= least + CASE WHEN st = 'Error' THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END THEN 'heuristic_strong' ELSE 'gray_zone' END AS method FROM z WHERE score >= least""",
    "q_edge_type_counts": f"WITH {GRAPH} SELECT trace_id, edge_type, count(*) AS n_edges FROM ge GROUP BY ALL",
    "q_graph_summary": f"WITH {GRAPH}, e AS (SELECT trace_id, count(*) AS n_edges FROM ge GROUP BY 1) SELECT trace_id, count(*) AS n_nodes, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t.lower()}" for t in ("Intent", "Planning", "Action", "Fact", "Conclusion", "Error")) + ", coalesce(any_value(e.n_edges), 0) AS n_edges FROM gn LEFT JOIN e USING (trace_id) GROUP BY trace_id",
    "q_degree": f"WITH {GRAPH}, x AS (SELECT trace_id, source AS node_id, 1 AS o, 0 AS i FROM ge UNION ALL SELECT trace_id, target, 0, 1 FROM ge) SELECT trace_id, node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY ALL",
    "q_simple_edges": f"WITH {GRAPH}, o AS (SELECT *, CASE edge_type WHEN 'Temporal' THEN 1 WHEN 'Call' THEN 3 WHEN 'Observation' THEN 6 ELSE 7 END AS k FROM ge) SELECT trace_id, source, target, arg_max(edge_type, k) AS edge_type, arg_max(score, k) AS score FROM o GROUP BY ALL",
    "q_edge_cost": f"""WITH {GRAPH}, t AS (SELECT ge.*, s.type AS source_type, d.type AS target_type FROM ge JOIN gn s ON s.trace_id = ge.trace_id AND s.node_id = ge.source JOIN gn d ON d.trace_id = ge.trace_id AND d.node_id = ge.target), c AS (
      SELECT *, CASE edge_type WHEN 'Temporal' THEN 1.3 WHEN 'Call' THEN 0.95 WHEN 'Retry' THEN 0.85 ELSE 0.65 END::DOUBLE AS base,
             CASE edge_type WHEN 'Temporal' THEN 0.25::DOUBLE WHEN 'Call' THEN 0.75 * 0.75::DOUBLE + 0.25 * score WHEN 'Retry' THEN 0.75 * 0.7::DOUBLE + 0.25 * score ELSE 0.75 * 0.85::DOUBLE + 0.25 * score END AS conf,
             CASE edge_type WHEN 'Temporal' THEN 'same_step_neighbor' WHEN 'Call' THEN 'data' WHEN 'Retry' THEN 'reasoning' ELSE 'tool_observation' END AS dependency,
             CASE edge_type WHEN 'Temporal' THEN 1.8 WHEN 'Call' THEN 0.6 WHEN 'Retry' THEN 0.45 ELSE 0.55 END::DOUBLE AS class FROM t)
      SELECT trace_id, source, target, edge_type, score, source_type, target_type, round(greatest(0.05::DOUBLE, base + 0.8::DOUBLE * (1 - score)), 4) AS cost, round(conf, 4) AS confidence, dependency, round(greatest(0.05::DOUBLE, class + 1.25::DOUBLE * (1 - conf)), 4) AS causal_cost FROM c""",
    "q_salient_budget": f"WITH {BUDGET} SELECT trace_id, item, size, place FROM kept",
    "q_prune_coverage": f"""WITH {BUDGET}, b AS (SELECT sn.*, kept.item FROM sn LEFT JOIN kept ON kept.trace_id = sn.trace_id AND kept.item = sn.node_id)
      SELECT trace_id, count(*) AS n_nodes, count(item) AS n_kept, round(count(item)::DOUBLE / count(*), 4) AS node_ratio,
             greatest(CAST(floor(sum(CASE WHEN item IS NOT NULL THEN length(content) ELSE 0 END) / 4) AS BIGINT), 1) AS tokens,
             round(count(*) FILTER (type = 'Error' AND item IS NOT NULL)::DOUBLE / greatest(count(*) FILTER (type = 'Error'), 1), 4) AS anomaly_coverage FROM b GROUP BY trace_id""",
    "q_anomaly_topk": f"WITH {CORPUS}, {salient('cn', 'sn')}, a AS (SELECT trace_id, node_id, round(saliency + {BONUS} + CASE WHEN type = 'Error' THEN 2.0::DOUBLE ELSE 0.0 END, 4) AS score FROM sn) SELECT trace_id, node_id, score, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, node_id DESC) AS INTEGER) AS rank FROM a QUALIFY rank <= 6",
    "q_bm25": f"""WITH {CORPUS}, {TF}, c AS (SELECT trace_id, count(*) AS n, avg(len) AS mean FROM len GROUP BY 1)
      SELECT tf.trace_id, tf.node_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf.tf * 2.5::DOUBLE) / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * (1 + ln(qtf))), 4) AS score
      FROM tf JOIN q USING (trace_id, term) JOIN df USING (trace_id, term) JOIN c USING (trace_id) JOIN len USING (trace_id, node_id) GROUP BY ALL""",
    "q_tfidf": f"""WITH {CORPUS}, {TF}, n AS (SELECT trace_id, count(*) AS n FROM cn GROUP BY 1), d AS (SELECT tf.trace_id, node_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (trace_id, term) JOIN n USING (trace_id)),
      qq AS (SELECT q.trace_id, term, (1 + ln(qtf)) * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1) AS q FROM q LEFT JOIN df USING (trace_id, term) JOIN n USING (trace_id)),
      norm AS (SELECT trace_id, node_id, sqrt(sum(w * w)) AS norm FROM d GROUP BY ALL), qn AS (SELECT trace_id, sqrt(sum(q * q)) AS qnorm FROM qq GROUP BY ALL)
      SELECT d.trace_id, d.node_id, round(sum(w * q) / (any_value(norm) * any_value(qnorm)), 4) AS score FROM d JOIN qq USING (trace_id, term) JOIN norm USING (trace_id, node_id) JOIN qn USING (trace_id) GROUP BY ALL""",
    "q_temporal_window": f"WITH {CORPUS}, a AS (SELECT trace_id, ord FROM cn WHERE type IN ('Conclusion', 'Planning')) SELECT cn.trace_id, node_id, cn.ord, min(abs(cn.ord - a.ord)) AS distance FROM cn JOIN a ON a.trace_id = cn.trace_id GROUP BY ALL HAVING min(abs(cn.ord - a.ord)) <= 8",
    "q_anomaly_neighborhood": f"""WITH {GRAPH}, {salient('gn', 'sn')}, sd AS (SELECT trace_id, node_id FROM sn QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY round(saliency + {BONUS} + CASE WHEN type = 'Error' THEN 2.0::DOUBLE ELSE 0.0 END, 4) DESC, node_id DESC) <= 6),
      b AS (SELECT trace_id, source AS a, target AS z FROM ge UNION SELECT trace_id, target, source FROM ge), one AS (SELECT sd.trace_id, z AS node_id FROM sd JOIN b ON b.trace_id = sd.trace_id AND a = node_id),
      two AS (SELECT o.trace_id, z AS node_id FROM (SELECT DISTINCT * FROM one) o JOIN b ON b.trace_id = o.trace_id AND a = node_id), every AS (SELECT *, 0 AS hops FROM sd UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two)
      SELECT trace_id, node_id, min(hops) AS hops FROM every GROUP BY ALL""",
    "q_outcome_slice": f"""WITH RECURSIVE {GRAPH}, an AS (SELECT trace_id, node_id FROM (SELECT *, max(ord) OVER w AS l, max(CASE WHEN type = 'Conclusion' THEN 1 ELSE 0 END) OVER w AS a FROM gn WINDOW w AS (PARTITION BY trace_id)) WHERE type = 'Conclusion' OR (a = 0 AND ord = l)),
      s AS (SELECT trace_id, node_id, 0 AS run, 0 AS hops FROM an UNION SELECT s.trace_id, e.source, CASE WHEN e.edge_type = 'Temporal' THEN s.run + 1 ELSE 0 END, s.hops + 1 FROM s JOIN ge e ON e.trace_id = s.trace_id AND e.target = s.node_id WHERE s.hops < 4 AND CASE WHEN e.edge_type = 'Temporal' THEN s.run + 1 ELSE 0 END <= 2)
      SELECT trace_id, node_id, min(hops) AS hops FROM s GROUP BY ALL""",
    "q_rca_table": f"""WITH {ES}, {NODES}, r AS (SELECT trace_id, node_id AS error_id, type, ord, last_value(CASE WHEN type != 'Error' THEN node_id END IGNORE NULLS) OVER (PARTITION BY trace_id, tool ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS producer, count(*) OVER (PARTITION BY trace_id) AS n FROM gn),
      s AS (SELECT trace_id, error_id, producer, ord, round(1 + 0.5::DOUBLE + CASE WHEN producer IS NOT NULL THEN -0.55::DOUBLE ELSE 0.0 END + least(ord::DOUBLE / n, 1.0), 4) AS score FROM r WHERE type = 'Error')
      SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, ord) AS INTEGER) AS rank, error_id, producer, score FROM s QUALIFY rank <= 12""",
    "q_origin_asof": f"WITH {ES} SELECT a.trace_id, a.span_id, arg_max(b.span_id, b.pos) AS origin_id FROM es a JOIN es b ON b.trace_id = a.trace_id AND b.input = a.input AND b.pos < a.pos GROUP BY ALL",
    "q_prior_evidence": f"WITH {DIALOGUE} SELECT a.trace_id, a.step, CAST(least(coalesce(sum(length(b.content)) + count(b.step) - 1, 0), 30000) AS BIGINT) AS evidence_chars, count(b.step) AS evidence_turns FROM turns a LEFT JOIN turns b ON b.trace_id = a.trace_id AND b.step < a.step GROUP BY ALL",
    "q_delivery_states": f"""WITH {DIALOGUE}, x AS (SELECT trace_id, step, role, list_distinct({TOKENS}) AS w, lead(step) OVER o AS t, lead(role) OVER o AS tr, lead(content) OVER o AS tc FROM turns WINDOW o AS (PARTITION BY trace_id ORDER BY step)),
      y AS (SELECT trace_id, step, t, len(list_intersect(w, list_distinct({TOKENS.replace('content', 'tc')}))) AS overlap FROM x WHERE t IS NOT NULL AND tr != role)
      SELECT trace_id, step AS source, t AS target, CAST(overlap AS INTEGER) AS overlap, CASE WHEN overlap >= 3 THEN 'PROPAGATED' WHEN overlap >= 1 THEN 'TRANSFORMED' ELSE 'EXPOSED' END AS state, round(least(0.45::DOUBLE + 0.1::DOUBLE * overlap, 1.0), 2) AS confidence FROM y""",
    "q_propagation_final": f"""WITH RECURSIVE {DIALOGUE}, x AS (SELECT trace_id, step, role, list_distinct({TOKENS}) AS w, lead(step) OVER o AS t, lead(role) OVER o AS tr, lead(content) OVER o AS tc FROM turns WINDOW o AS (PARTITION BY trace_id ORDER BY step)),
      y AS (SELECT trace_id, step AS source, t AS target, len(list_intersect(w, list_distinct({TOKENS.replace('content', 'tc')}))) AS overlap FROM x WHERE t IS NOT NULL AND tr != role),
      go AS (SELECT trace_id, source, target AS spot, round(least(0.45::DOUBLE + 0.1::DOUBLE * overlap, 1.0), 2) AS confidence, 1 AS hops FROM y WHERE overlap >= 1
        UNION ALL SELECT go.trace_id, go.source, y.target, least(go.confidence, round(least(0.45::DOUBLE + 0.1::DOUBLE * overlap, 1.0), 2)), go.hops + 1 FROM go JOIN y ON y.trace_id = go.trace_id AND y.source = go.spot WHERE overlap >= 1),
      f AS (SELECT trace_id, max(step) AS final_step FROM turns WHERE role = 'assistant' GROUP BY 1),
      r AS (SELECT trace_id, source, max(confidence) AS confidence, min(hops) AS hops FROM (SELECT go.trace_id, source, confidence, hops FROM go JOIN f ON f.trace_id = go.trace_id AND final_step = spot AND final_step != source
        UNION ALL SELECT trace_id, final_step, 1.0, 0 FROM f) GROUP BY trace_id, source)
      SELECT y.trace_id, y.source, hops IS NOT NULL AS reaches_final, confidence, hops FROM y LEFT JOIN r ON r.trace_id = y.trace_id AND r.source = y.source""",
    "q_checklist_fill": """WITH c(i, "check") AS (VALUES (0, 'task_understanding'), (1, 'planning'), (2, 'tool_selection'), (3, 'tool_arguments'), (4, 'tool_results'), (5, 'evidence_use'), (6, 'error_recovery'), (7, 'format'), (8, 'final_answer')),
      j AS (SELECT n_regionkey AS trace_id, n_nationkey % 9 AS i, min(CASE WHEN n_nationkey % 3 = 0 THEN 'fail' ELSE 'pass' END) AS verdict FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1, 2)
      SELECT t.trace_id, c."check", coalesce(verdict, 'not_checked') AS verdict FROM (SELECT DISTINCT trace_id FROM j) t CROSS JOIN c LEFT JOIN j ON j.trace_id = t.trace_id AND j.i = c.i""",
    "q_msg_role_counts": f"""WITH {DIALOGUE} SELECT trace_id, count(*) AS messages, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, CAST(sum(length(content)) AS BIGINT) AS chars,
      md5(coalesce(arg_min(content, step) FILTER (role = 'user'), '')) AS input_md5, md5(coalesce(arg_max(content, step) FILTER (role = 'assistant'), '')) AS output_md5 FROM turns GROUP BY trace_id""",
    "q_token_estimate": "WITH c AS (SELECT doc_id, length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[^\\x{4e00}-\\x{9fff}]', '', 'g')) AS cjk, length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f]', '', 'g')) AS asc FROM documents) SELECT doc_id, CAST(cjk + (asc + 2) // 3 + (n - cjk - asc + 1) // 2 AS BIGINT) AS tokens FROM c".replace("asc", "ascii_"),
    "q_middle_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 1200 THEN left(text, 791) || chr(10) || '...[cut]...' || chr(10) || right(text, 396) ELSE text END) AS cut_md5 FROM documents",
    "q_content_flags": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '<[^>]+>') AS has_tag, regexp_matches(coalesce(text, ''), '[0-9]') AS has_number, regexp_matches(lower(coalesce(text, '')), 'error|failed|exception|timeout|invalid|missing') AS has_error_terms, contains(lower(coalesce(text, '')), 'final answer') AS has_final_answer, regexp_matches(coalesce(text, ''), '(Tool|Function):\s*\S') AS has_tool, regexp_matches(coalesce(text, ''), '^\s*[\[{]') AS json_like FROM documents",
    "q_fingerprint": rf"SELECT doc_id, md5(left(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 800)) AS fingerprint, md5(CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 160 THEN left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 157) || '...' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS display, CAST(len({SAFE_IDS}) AS BIGINT) AS n_ids FROM documents",
    "q_tool_names": f"WITH {ES} SELECT trace_id, span_id, tool, md5(regexp_replace(content, '[^A-Za-z0-9_.\\-]+', '_', 'g')) AS safe, 0::BIGINT AS n_artifacts FROM es",
    "q_bytes_label": "WITH b AS (SELECT doc_id, n_chars::DOUBLE * pow(10.0::DOUBLE, (doc_id % 10)::DOUBLE) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', round(n, 1)) WHEN n < 1048576 THEN printf('%.1f KiB', round(n / 1024, 1)) WHEN n < 1073741824 THEN printf('%.1f MiB', round(n / 1048576, 1)) WHEN n < 1099511627776 THEN printf('%.1f GiB', round(n / 1073741824, 1)) ELSE printf('%.1f TiB', round(n / 1099511627776, 1)) END AS label FROM b",
    "q_latency_percentiles": f"WITH {ES} SELECT trace_id, count(*) AS total, round(quantile_cont(duration * 1000, 0.5), 2) AS p50_ms, round(quantile_cont(duration * 1000, 0.95), 2) AS p95_ms, count(DISTINCT tool) AS protocols FROM es GROUP BY 1",
    "q_comm_error_rate": f"""WITH {ES}, {LATENCY}, a AS (SELECT trace_id, count(*) AS total, count(*) FILTER (status = 'Error') AS errors, count(*) FILTER (again) AS retries FROM lat GROUP BY 1)
      SELECT trace_id, errors, retries, round(100.0::DOUBLE * errors / total, 1) AS error_rate, CASE WHEN round(100.0::DOUBLE * errors / total, 1) >= 20 THEN 'critical' WHEN errors > 0 OR retries > 0 THEN 'warning' ELSE 'ok' END AS status FROM a""",
    "q_layer_rollup": f"""WITH {MONITOR}, m AS (SELECT system_id, layer, round(avg(measurement), 4) AS mean FROM ok GROUP BY ALL), r AS (SELECT system_id, count(*) AS n, max(CASE WHEN mean >= 95 THEN 3 WHEN mean >= 80 THEN 2 ELSE 1 END) AS r FROM m GROUP BY 1)
      SELECT system_id, CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'ok' END AS status, round(100.0::DOUBLE * n / 4, 1) AS coverage FROM r""",
    "q_monitor_reject": f"WITH {MONITOR} SELECT layer, CASE WHEN layer = 'invalid' THEN 'unknown layer' END AS error, count(*) AS n FROM me GROUP BY ALL",
    "q_monitor_range": f"WITH {MONITOR} SELECT seq, ts, system_id, layer, measurement FROM ok WHERE layer = 'hardware' ORDER BY seq DESC LIMIT 500",
    "q_monitor_retained": f"WITH {MONITOR} SELECT layer, count(*) AS n, min(seq) AS oldest FROM (SELECT * FROM ok ORDER BY seq DESC LIMIT 1000) GROUP BY 1",
    "q_monitor_snapshot": f"WITH {MONITOR}, l(layer) AS (VALUES ('hardware'), ('virtualization'), ('communication'), ('application')), x AS (SELECT system_id, layer, max(seq) AS seq, arg_max(measurement, seq) AS measurement, count(*) AS n_events FROM ok GROUP BY ALL) SELECT s.system_id, l.layer, x.seq, x.measurement, coalesce(n_events, 0) AS n_events FROM (SELECT DISTINCT system_id FROM ok) s CROSS JOIN l LEFT JOIN x ON x.system_id = s.system_id AND x.layer = l.layer",
    "q_accelerator_rollup": """WITH s AS (SELECT l_returnflag AS pod, l_suppkey AS device, CAST(l_linenumber % 4 AS INTEGER) AS m, arg_max(l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS v FROM lineitem GROUP BY ALL),
      w AS (SELECT pod, device, max(v) FILTER (m = 0) AS u, max(v) FILTER (m = 1) AS mem, max(v) FILTER (m = 2) AS t, max(v) FILTER (m = 3) AS e FROM s GROUP BY ALL)
      SELECT pod, count(*) AS devices, round(avg(u), 4) AS mean_utilization, max(u) AS max_utilization, max(t) AS max_temperature, sum(mem) AS memory_used, count(*) FILTER (e != 0) AS error_devices FROM w GROUP BY 1""",
    "q_counter_delta": f"WITH {ES} SELECT trace_id, span_id, round(greatest(duration - coalesce(lag(duration) OVER (PARTITION BY trace_id, tool ORDER BY pos), duration), 0.0::DOUBLE), 4) AS delta FROM es",
    "q_event_correlation": f"WITH {ES}, {MONITOR} SELECT ok.system_id, ok.layer, count(DISTINCT ok.seq) AS events, count(DISTINCT es.span_id) AS failed_spans FROM ok JOIN es ON CAST(es.trace_id AS VARCHAR) = ok.system_id AND es.status = 'Error' AND abs(epoch(date_trunc('second', ok.ts)) - epoch(date_trunc('second', es.ts))) <= 300 GROUP BY ALL",
    "q_k8s_quantity": "SELECT n_nationkey, round(CASE n_nationkey % 7 WHEN 0 THEN n_nationkey * 1e-3 WHEN 1 THEN n_nationkey * 1024.0 WHEN 2 THEN n_nationkey * 1048576.0 WHEN 3 THEN n_nationkey WHEN 4 THEN n_nationkey * 1e9 WHEN 5 THEN n_nationkey * 1e-9 END::DOUBLE, 9) AS quantity FROM nation",
    "q_coverage_policies": f"""WITH {PAIRS}, x AS (SELECT human_impact, 'semantic' AS policy, semantic AS hit FROM ju UNION ALL SELECT human_impact, 'exact', exact FROM ju UNION ALL SELECT human_impact, 'chain_aware', chain_aware FROM ju UNION ALL SELECT human_impact, 'strict', strict FROM ju)
      SELECT policy, CASE WHEN grouping(human_impact) = 1 THEN 'ALL' ELSE human_impact END AS impact, count(*) AS human_total, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS coverage FROM x GROUP BY GROUPING SETS ((policy, human_impact), (policy))""",
    "q_location_audit": f"WITH {PAIRS}, r AS (SELECT trace_id, CASE WHEN exact THEN 'exact' WHEN chain_aware THEN 'adjacent' WHEN a IS NULL THEN 'unknown' ELSE 'different' END AS relation FROM ju) SELECT trace_id, count(*) AS pairs, " + ", ".join(f"count(*) FILTER (relation = '{x}') AS {x}" for x in ("exact", "adjacent", "unknown", "different")) + ", round(count(*) FILTER (relation = 'exact')::DOUBLE / count(*), 4) AS exact_rate FROM r GROUP BY 1",
    "q_macro_vs_pooled": f"WITH {PAIRS} SELECT trace_id, round((" + " + ".join(f"coalesce(count(*) FILTER (strict AND human_impact = '{i}')::DOUBLE / nullif(count(*) FILTER (human_impact = '{i}'), 0), 1.0)" for i in ("LOW", "MEDIUM", "HIGH")) + ") / 3, 4) AS macro, round(count(*) FILTER (strict)::DOUBLE / count(*), 4) AS pooled FROM ju GROUP BY 1",
    "q_token_savings": """WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS g FROM lineitem GROUP BY 1), u AS (SELECT o_orderpriority AS "group", sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS r, sum(coalesce(g, 0))::DOUBLE AS g FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
      SELECT "group", round(r, 2) AS raw, round(g, 2) AS graph, round((r - g) / r, 4) AS saving FROM u""",
    "q_better_of": f"""WITH {PAIRS}, r AS (SELECT trace_id, round(count(*) FILTER (exact)::DOUBLE / count(*), 4) AS raw FROM ju GROUP BY 1), g AS (SELECT trace_id, round(count(*) FILTER (semantic)::DOUBLE / count(*), 4) AS graph FROM ju GROUP BY 1)
      SELECT trace_id, CASE WHEN raw IS NOT NULL AND graph IS NOT NULL AND raw >= graph THEN 'raw' ELSE 'graph' END AS source, CASE WHEN raw IS NOT NULL AND graph IS NOT NULL AND raw >= graph THEN raw ELSE coalesce(graph, raw) END AS coverage
      FROM r FULL JOIN (SELECT * FROM g WHERE graph > 0.4) g USING (trace_id)""",
    "q_source_otlp": "SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, event_type AS span_name, 'Client' AS span_kind, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ok' END AS status_code, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, 'PT0.000000S' AS duration, props AS input FROM events",
    "q_source_dialogue": """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, 'dlg' || lpad(CAST(i + 1 AS VARCHAR), 13, '0') AS span_id, 'dlg0000000000000' AS parent_span_id, upper(substr(role, 1, 1)) || substr(role, 2) AS span_name, i + 1 AS place, md5(text) AS output_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
      UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'dlg0000000000000', NULL, 'dialogue', 0, md5('') FROM conversations)
      SELECT trace_id, span_id, parent_span_id, span_name, strftime(TIMESTAMP '1970-01-01' + to_microseconds(place * 100000), '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, output_md5 FROM t""",
    "q_source_event_log": "SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS spans, 1::BIGINT AS roots, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1",
    "q_source_prometheus": "SELECT 'retail_price' AS name, p_brand AS brand, p_partkey AS part, p_size::DOUBLE AS value FROM part",
    "q_digest": f"""WITH {ES}, t AS (SELECT trace_id, tool, count(*) AS n FROM es GROUP BY ALL), l AS (SELECT trace_id, string_agg(tool || '=' || n, ',' ORDER BY n DESC, tool) AS tools, count(*) FILTER (n >= 4) AS repeated_tools FROM t GROUP BY 1),
      s AS (SELECT trace_id, span_id, pos FROM es WHERE status = 'Error' QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY pos) <= 80), g AS (SELECT trace_id, string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY pos) AS suspicious FROM s GROUP BY 1),
      c AS (SELECT trace_id, count(*) AS spans, count(*) FILTER (status = 'Error') AS errors FROM es GROUP BY 1)
      SELECT trace_id, spans, errors, tools, repeated_tools, coalesce(suspicious, '') AS suspicious FROM c LEFT JOIN l USING (trace_id) LEFT JOIN g USING (trace_id)""",
    "q_judge_offline": f"WITH {ES}, c AS (SELECT CAST(trace_id AS VARCHAR) AS trace_id, count(*) AS n FROM es WHERE status = 'Error' GROUP BY 1) SELECT trace_id, CASE WHEN n > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS impact FROM c",
    "q_fault_report": f"""WITH {ES}, {REPEATED}, {BEFORE_FINAL}, {SHARED}, f AS (
      SELECT trace_id, 'F3' AS fault_id, attempts AS n FROM rep UNION ALL SELECT trace_id, 'F10', errors FROM rep WHERE errors >= 2
      UNION ALL SELECT trace_id, 'F11', count(*) FROM bf GROUP BY trace_id UNION ALL SELECT trace_id, 'F12', errors FROM sp
      UNION ALL SELECT trace_id, 'F4', count(*) FROM es WHERE status = 'Error' GROUP BY trace_id),
      c(fault_id, t) AS (VALUES ('F3', 'Action loop | 0.78'), ('F10', 'Failed retry | 0.84'), ('F11', 'Ignored error | 0.72'), ('F12', 'Cascading failure | 0.76'), ('F4', 'Execution crash | 0.98'))
      SELECT trace_id, '# Trace ' || trace_id || chr(10) || chr(10) || '| fault | name | confidence | evidence |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || fault_id || ' | ' || t || ' | ' || n || ' |', chr(10) ORDER BY fault_id) || chr(10) AS report FROM f JOIN c USING (fault_id) GROUP BY trace_id""",
    "q_mermaid": f"""WITH {ES}, {NODES}, n AS (SELECT * FROM gn), x AS (
      SELECT trace_id, 0 AS part, ord AS a, 0 AS b, '  n' || node_id || '["' || type || ': ' || regexp_replace(CASE WHEN length(content) > 60 THEN left(content, 57) || '...' ELSE content END, '["\\[\\]\n|]', ' ', 'g') || '"]:::' || lower(type) AS line FROM n
      UNION ALL SELECT trace_id, 1, source, target, '  n' || source || ' -->|Temporal| n' || target FROM (SELECT trace_id, node_id AS source, lead(node_id) OVER (PARTITION BY trace_id ORDER BY ord) AS target FROM n) WHERE target IS NOT NULL)
      SELECT trace_id, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b) AS chart FROM x GROUP BY trace_id""",
    "q_agent_scopes": f"""WITH {ES}, r AS (SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS depth FROM es WHERE tool = 'signup'),
      s AS (SELECT es.trace_id, r.depth FROM es LEFT JOIN r ON r.trace_id = es.trace_id AND r.span_id = CASE WHEN tool = 'signup' THEN es.span_id ELSE parent_id END)
      SELECT trace_id, CASE WHEN depth = 0 THEN 'main' WHEN depth > 0 THEN 'subagent' END AS agent_role, count(*) AS n, CAST(max(depth) AS INTEGER) AS deepest FROM s GROUP BY ALL""",
    "q_agent_rollup": f"""WITH {ES}, r AS (SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY pos) - 1 AS depth FROM es WHERE tool = 'signup')
      SELECT es.trace_id, r.span_id AS agent_id, CAST(max(r.depth) AS INTEGER) AS depth, count(*) AS n_spans, count(*) FILTER (status = 'Error') AS errors FROM es JOIN r ON r.trace_id = es.trace_id AND r.span_id = CASE WHEN tool = 'signup' THEN es.span_id ELSE parent_id END GROUP BY es.trace_id, r.span_id""",
    "q_agent_spawn_edges": f"""WITH {ES}, a AS (SELECT trace_id, span_id, pos, CASE WHEN tool = 'signup' THEN span_id ELSE parent_id END AS agent_id FROM es), l AS (SELECT trace_id, agent_id, arg_max(span_id, pos) AS last FROM a GROUP BY ALL),
      r AS (SELECT trace_id, span_id AS agent_id, parent_id FROM es WHERE tool = 'signup' AND parent_id IS NOT NULL)
      SELECT trace_id, parent_id AS source, agent_id AS target, 'AgentSpawn' AS edge_type, 1.0::DOUBLE AS score FROM r
      UNION ALL SELECT r.trace_id, l.last, r.parent_id, 'SubagentReturn', 0.96::DOUBLE FROM r JOIN l ON l.trace_id = r.trace_id AND l.agent_id = r.agent_id""",
    "q_outcome_diagnosis": f"WITH {ES} SELECT trace_id, bool_or(is_final) AS answered, max(pos) - coalesce(max(pos) FILTER (is_final), 0) AS after_final, arg_max(status, pos) = 'Error' AS ends_in_error FROM es GROUP BY 1",
    "q_verdicts": f"WITH {ES} SELECT trace_id, CASE WHEN status = 'Error' OR tool = 'click' THEN 'invalid' ELSE 'valid' END AS verdict, count(*) AS n FROM es GROUP BY ALL",
    "q_date_mismatch": "SELECT o_custkey AS trace_id, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) != CAST(l_shipdate AS DATE) GROUP BY 1",
    "q_resource_merge": "SELECT user_id AS trace_id, event_type AS key, arg_min(props, event_id) AS value FROM events GROUP BY ALL",
    "q_chain_normalize": f"""WITH {ES}, x AS (SELECT trace_id, span_id AS a, pos, lead(span_id) OVER w AS b, lead(span_id, 2) OVER w AS c FROM es WINDOW w AS (PARTITION BY trace_id ORDER BY pos) QUALIFY c IS NOT NULL)
      SELECT trace_id, a AS chain, CASE WHEN pos % 3 = 0 THEN b || '>' || a || '>' || c ELSE a || '>' || b || '>' || c END AS path, pos % 3 != 0 AS path_valid FROM x""",
    "q_semantic_edges": f"""WITH {DIALOGUE}, x AS (SELECT trace_id, step, role, list_distinct({TOKENS}) AS w, lead(step) OVER o AS t, lead(role) OVER o AS tr, lead(content) OVER o AS tc FROM turns WINDOW o AS (PARTITION BY trace_id ORDER BY step)),
      y AS (SELECT trace_id, step, t, len(list_intersect(w, list_distinct({TOKENS.replace('content', 'tc')}))) AS overlap FROM x WHERE t IS NOT NULL AND tr != role)
      SELECT trace_id, step AS source, t AS target, CASE WHEN overlap >= 1 THEN 'SemanticPropagation' ELSE 'EvidenceExposure' END AS edge_type, round(least(0.45::DOUBLE + 0.1::DOUBLE * overlap, 1.0), 2) AS score FROM y""",
    "q_semantic_scores": f"""WITH {ES}, v AS (SELECT trace_id, span_id, pos, CASE WHEN status = 'Error' THEN 1.0 ELSE 0.6 END::DOUBLE AS s FROM es WHERE status = 'Error' OR tool = 'click')
      SELECT trace_id, span_id, round(s * CASE WHEN pos % 2 = 0 THEN greatest((pos % 10)::DOUBLE / 10, 0.65::DOUBLE) ELSE 0.35::DOUBLE END, 4) AS semantic_error_score FROM v""",
    "q_missed_items": f"WITH {PAIRS} SELECT trace_id, human_impact AS impact, count(*) FILTER (NOT exact AND NOT chain_aware) AS missed, count(*) FILTER (a IS NULL) AS extra FROM ju GROUP BY ALL",
    "q_signatures": "",
}

# --- semantic validation: the rules written out over the numbers of conversation and turn

IGN = "(?:不可靠|忽略|未采用|不采用|不使用|无关|过期|discard|unreliable|outdated|doesn[''’]t\\s+match|ignored|not\\s+used)"
STEPS = """b AS (SELECT conv_id AS c, CAST(row_number() OVER w - 1 AS BIGINT) AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  f AS (SELECT *, 's' || c || '_' || t AS span_id, CASE WHEN t > 0 THEN 's' || c || CASE WHEN c % 6 = 0 AND t = 3 THEN '_2' ELSE '_0' END END AS parent_id, t > 0 AND t % 2 = 0 AS is_tool, t % 2 = 1 AS is_model,
    'host' || (c % 7) || '.example' AS host, 'call_' || c || '_' || t AS tool_id, CASE WHEN (c + t) % 13 = 0 THEN 'Error' ELSE 'Ok' END AS status,
    CASE WHEN c % 4 = 0 THEN 'Please find "code" of 2024-03-12' ELSE 'Please find "code"' END AS task FROM b),
  ss AS (SELECT c AS trace_id, *, CASE WHEN (c + t) % 7 = 0 THEN '' WHEN (c + t) % 11 = 0 THEN '{"success":false,"error":"down","city":"B"}'
      ELSE 'dist ' || t || '0 km' || chr(10) || 'mass ' || (c % 50) || '.5 kg' || chr(10) || 'code ' || c || '-' || t || chr(10) || 'as of 2024-03-1' || t || chr(10) || CASE WHEN c % 9 = 4 THEN 'Status: 404' ELSE 'Status: 200' END END AS result,
    CASE WHEN c % 2 = 0 THEN '{"url":"http://www.' || host || '/doc/abcdefg' || c || '1","city":"a"}' ELSE '{"query":"code","ref_id":"opaque' || c || 'x' || t || '"}' END AS arguments,
    'turn ' || t || chr(10) || CASE (c + t) % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'code ' || c || '-' || (t - 1) WHEN 2 THEN 'dist ' || (t - 1) || '0 km mass ' || (c % 50) || '.5 kg code ' || c || '-' || (t - 1)
      WHEN 3 THEN 'outdated ' || host || ' dist ' || (t - 1) || '0 km' ELSE 'dist ' || (t - 1) || '0 km' || chr(10) || 'mass ' || (c % 50) || '.5 kg' || chr(10) || 'code ' || c || '-' || (t - 1) END AS output FROM f)"""


def facts(t: str) -> str:
    """Signatures of a text."""
    measures = f"list_transform(regexp_extract_all({t}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])([<>]?\\d+(?:\\.\\d+)?\\s*(?:℃|°C|%|级|km|m|kg|g|ms|s|秒|分钟|小时|元|美元|MB|GB))', 1), lambda x: regexp_replace(x, '\\s+', '', 'g'))"
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[*#|]', '', 'g')))"
    short = f"list_filter({lines}, lambda x: length(x) BETWEEN 2 AND 24 AND NOT regexp_matches(x, '(?i)^(?:URL|Status|Title|Provider|Content|Query|Source):') AND regexp_matches(x, '[a-zA-Z一-鿿]'))"
    return f"list_distinct(list_concat({measures}, list_transform({short}, lambda x: regexp_replace(x, '\\s+', '', 'g'))))"


LINKS = f"""nm AS (SELECT a.trace_id, a.span_id AS source, b.span_id AS consumer, 'tool_call_id' AS method FROM ss a JOIN ss b ON a.trace_id = b.trace_id AND a.is_tool AND b.is_model AND b.t = a.t + 1 AND b.c % 3 != 0),
  cd AS (SELECT * FROM nm UNION ALL SELECT a.trace_id, a.span_id, b.span_id, 'same_branch_order' FROM ss a JOIN ss b ON a.trace_id = b.trace_id AND a.is_tool AND b.is_model AND a.parent_id = b.parent_id AND b.t > a.t
    WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.trace_id = a.trace_id AND nm.source = a.span_id)),
  ov AS (SELECT cd.*, CASE WHEN a.c % 2 = 0 THEN a.host ELSE '' END AS host, b.output, regexp_replace(b.output, '\\s+', '', 'g') AS dense,
    list_sort(list_filter({facts('a.result')}, lambda x: contains(regexp_replace(b.output, '\\s+', '', 'g'), x))) AS overlap FROM cd JOIN ss a ON a.trace_id = cd.trace_id AND a.span_id = cd.source JOIN ss b ON b.trace_id = cd.trace_id AND b.span_id = cd.consumer),
  ig AS (SELECT *, len(overlap) AS k, CASE WHEN host != '' THEN regexp_matches(output, '(?is)(?:' || regexp_escape(host) || '.{{0,160}}{IGN}|{IGN}.{{0,160}}' || regexp_escape(host) || ')')
    ELSE len(list_filter(overlap[1:12], lambda x: regexp_matches(dense, '(?is)(?:' || regexp_escape(x) || '.{{0,100}}{IGN}|{IGN}.{{0,100}}' || regexp_escape(x) || ')'))) > 0 END AS ignored FROM ov),
  st AS (SELECT *, CASE WHEN ignored THEN 'REJECTED' WHEN k >= 3 THEN 'PROPAGATED' WHEN method = 'tool_call_id' THEN CASE WHEN k >= 1 THEN 'TRANSFORMED' ELSE 'EXPOSED' END END AS state FROM ig),
  lk AS (SELECT trace_id, source, consumer, method, state, overlap[1:12] AS overlap, round(CASE WHEN method = 'tool_call_id' THEN greatest(least(1.0, 0.45 + 0.1::DOUBLE * k), CASE WHEN state IN ('EXPOSED', 'REJECTED') THEN 0.9 ELSE 0.95 END)
      WHEN state = 'PROPAGATED' THEN least(least(1.0, 0.45 + 0.1::DOUBLE * k), 0.82) ELSE least(1.0, 0.45 + 0.1::DOUBLE * k) END::DOUBLE, 2) AS confidence FROM st WHERE state IS NOT NULL)"""
RETURNS = f"""rt AS (SELECT a.trace_id, b.span_id AS source, a.span_id AS consumer, len(list_filter({facts('b.output')}, lambda x: contains(regexp_replace(a.result, '\\s+', '', 'g'), x))) AS k FROM ss a JOIN ss b ON b.trace_id = a.trace_id AND b.parent_id = a.span_id AND a.is_tool AND b.is_model
    WHERE a.result != '' AND (k >= 3 OR contains(a.result, regexp_replace(b.output, '^\\s+|\\s+$', '', 'g'))))"""
FINALS = """fa AS (SELECT trace_id, coalesce(max(span_id) FILTER (NOT (c % 6 = 0 AND t = 3)), max(span_id)) AS final_id FROM ss WHERE is_model AND t + 1 = n GROUP BY 1)"""
FOUND = f"""cs AS (SELECT DISTINCT trace_id, source FROM lk WHERE state IN ('PROPAGATED', 'TRANSFORMED')),
  tl AS (SELECT ss.*, cs.source IS NOT NULL AS consumed, contains(result, 'code') AS echoed, status = 'Error' OR (c + t) % 11 = 0 AND (c + t) % 7 != 0 AS bad FROM ss LEFT JOIN cs ON cs.trace_id = ss.trace_id AND cs.source = ss.span_id WHERE is_tool),
  vi AS (
    SELECT trace_id, span_id, 'missing_required_argument' AS violation_type, 'argument_schema' AS dimension, 'HIGH' AS severity, 1.0::DOUBLE AS confidence FROM tl WHERE c % 5 = 0 AND c % 2 = 1
    UNION ALL SELECT trace_id, span_id, 'tool_execution_failure', 'execution_status', 'HIGH', 1.0 FROM tl WHERE bad
    UNION ALL SELECT trace_id, span_id, 'empty_tool_result', 'result_presence', 'MEDIUM', 1.0 FROM tl WHERE NOT bad AND result = ''
    UNION ALL SELECT trace_id, span_id, 'http_failure', 'http_status', 'HIGH', 1.0 FROM tl WHERE contains(result, 'Status: 404')
    UNION ALL SELECT trace_id, span_id, 'temporal_mismatch', 'date', CASE WHEN consumed THEN 'HIGH' ELSE 'MEDIUM' END, 0.96 FROM tl WHERE c % 4 = 0 AND contains(result, 'as of') AND t != 2
    UNION ALL SELECT trace_id, span_id, 'ungrounded_tool_argument', 'argument_provenance', CASE WHEN consumed AND NOT echoed THEN 'HIGH' ELSE 'MEDIUM' END, CASE WHEN echoed THEN 0.78 ELSE 0.94 END FROM tl
    UNION ALL SELECT trace_id, span_id, 'argument_result_mismatch', 'city', 'HIGH', 0.99 FROM tl WHERE c % 2 = 0 AND contains(result, '"city":"B"'))"""
REACH = f"""el AS (SELECT trace_id, source, consumer, state FROM lk UNION ALL SELECT trace_id, source, consumer, 'PROPAGATED' FROM rt),
  vs AS (SELECT DISTINCT trace_id, span_id AS source FROM vi),
  go AS (SELECT trace_id, source, source AS spot FROM vs UNION SELECT go.trace_id, go.source, el.consumer FROM go JOIN el ON el.trace_id = go.trace_id AND el.source = go.spot AND el.state IN ('PROPAGATED', 'TRANSFORMED')),
  re AS (SELECT go.trace_id, go.source, bool_or(fa.final_id IS NOT NULL) AS reaches FROM go LEFT JOIN fa ON fa.trace_id = go.trace_id AND fa.final_id = go.spot GROUP BY ALL),
  pr AS (SELECT re.trace_id, re.source, re.reaches AS reaches_final, CASE WHEN any_value(re.reaches) THEN 'PROPAGATED' WHEN bool_or(el.state = 'REJECTED') THEN 'REJECTED' WHEN bool_or(el.state = 'EXPOSED') THEN 'EXPOSED' WHEN count(el.state) > 0 THEN 'PROPAGATED' ELSE 'NOT_EXPOSED' END AS state
    FROM re LEFT JOIN el ON el.trace_id = re.trace_id AND el.source = re.source GROUP BY re.trace_id, re.source, re.reaches)"""
ORIGIN = """orr AS (SELECT trace_id, span_id, 's' || c || '_' || (t - 1) AS origin_id FROM ss WHERE is_tool)"""
ORACLE |= {
    "q_delivery_links": f"WITH {STEPS}, {LINKS} SELECT trace_id, source, consumer, method, state, array_to_string(overlap, '|') AS matched, confidence, CASE state WHEN 'REJECTED' THEN 'ignored' WHEN 'EXPOSED' THEN 'exposed' ELSE 'consumed' END AS relation FROM lk",
    "q_subagent_returns": f"WITH {STEPS}, {RETURNS} SELECT trace_id, source, consumer, least(k, 12) AS n_matched, 0.96::DOUBLE AS confidence FROM rt",
    "q_final_answers": f"WITH {STEPS}, {FINALS} SELECT * FROM fa",
    "q_argument_origins": f"WITH {STEPS}, {ORIGIN} SELECT * FROM orr",
    "q_tool_evidence": f"WITH {STEPS} SELECT a.trace_id, a.span_id, md5(string_agg(b.result, chr(10) ORDER BY b.t)) AS evidence_md5 FROM ss a JOIN ss b ON b.trace_id = a.trace_id AND a.is_tool AND b.is_tool AND b.t < a.t AND b.result != '' GROUP BY ALL",
    "q_call_violations": f"WITH {STEPS}, {LINKS}, {FOUND} SELECT * FROM vi",
    "q_semantic_checks": f"""WITH RECURSIVE {STEPS}, {LINKS}, {RETURNS}, {FINALS}, {FOUND}, {REACH}, {ORIGIN}, k AS (SELECT trace_id, span_id, string_agg(violation_type, ',' ORDER BY violation_type) AS violation_types FROM vi GROUP BY ALL)
      SELECT tl.trace_id, tl.span_id, 'lookup' AS tool, origin_id, consumed, CASE WHEN k.violation_types IS NULL THEN 'valid' WHEN contains(k.violation_types, 'ungrounded') THEN 'uncertain' ELSE 'invalid' END AS verdict, coalesce(k.violation_types, '') AS violation_types, coalesce(reaches_final, false) AS reaches_final
      FROM tl LEFT JOIN k USING (trace_id, span_id) LEFT JOIN pr ON pr.trace_id = tl.trace_id AND pr.source = tl.span_id LEFT JOIN orr ON orr.trace_id = tl.trace_id AND orr.span_id = tl.span_id""",
    "q_semantic_propagation": f"WITH RECURSIVE {STEPS}, {LINKS}, {RETURNS}, {FINALS}, {FOUND}, {REACH} SELECT trace_id, source, state, reaches_final FROM pr",
    "q_rule_findings": f"""WITH {STEPS}, {LINKS}, {FOUND}, r AS (
      SELECT trace_id, span_id, CASE WHEN violation_type IN ('tool_execution_failure', 'http_failure') THEN 'F4' WHEN violation_type IN ('missing_required_argument', 'argument_result_mismatch') THEN 'F9' WHEN violation_type = 'ungrounded_tool_argument' THEN 'F9-U' WHEN violation_type = 'temporal_mismatch' THEN 'F1/F6' END AS fault_id FROM vi
      UNION ALL SELECT trace_id, span_id, 'F6-candidate' FROM tl WHERE NOT consumed AND result != '')
      SELECT trace_id, fault_id, CASE fault_id WHEN 'F4' THEN 0.98 WHEN 'F9' THEN 0.97 WHEN 'F9-U' THEN 0.82 WHEN 'F1/F6' THEN 0.88 ELSE 0.55 END::DOUBLE AS confidence, count(DISTINCT span_id) AS n_evidence, fault_id NOT IN ('F4', 'F9') AS requires_review FROM r WHERE fault_id IS NOT NULL GROUP BY ALL""",
}

# --- suspicion, paths to the outcome, digests

AGENT = f"""{ES}, gn AS (SELECT trace_id, span_id AS node_id, pos AS ord, span_id, parent_id, tool,
    CASE tool WHEN 'click' THEN 'Action' WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Fact' WHEN 'purchase' THEN 'Conclusion' ELSE 'Planning' END AS type,
    CASE tool WHEN 'click' THEN 'Tool: editor | write config_' || (span_id % 7) || '.json' || CASE WHEN pos % 3 = 0 THEN ' with a stale value' ELSE '' END WHEN 'error' THEN 'failed on config_' || (span_id % 7) || '.json'
      WHEN 'view' THEN 'search result of json.loads config_' || (span_id % 7) || '.json' WHEN 'purchase' THEN 'the final answer is here' ELSE 'let me plan step ' || (span_id % 7) END AS content FROM es), {salient('gn', 'sn')},
  te AS ({TEMPORAL}), oe AS ({OBSERVE}), re AS ({RETRY}), ge AS (SELECT * FROM te UNION ALL SELECT * FROM oe UNION ALL SELECT * FROM re),
  so AS (SELECT trace_id, source, target, arg_max(edge_type, k) AS edge_type, arg_max(score, k) AS score FROM (SELECT *, CASE edge_type WHEN 'Temporal' THEN 1 WHEN 'Observation' THEN 6 ELSE 7 END AS k FROM ge) GROUP BY ALL)"""


def hit(t: str, words: tuple[str, ...]) -> str:
    """Count of the words that a text holds."""
    return "(" + " + ".join(f"CAST(contains(lower({t}), '{w}') AS INTEGER)" for w in words) + ")"


FAILS = ("error", "failed", "failure", "invalid", "timeout", "timed out", "exception", "forbidden", "unauthorized", "authentication", "permission", "service unavailable", "404", "403", "500", "insufficient", "not found")
AGAIN = ("retry", "again", "re-run", "rerun", "try another", "another attempt")
TOOLS = ("tool", "function", "api", "call", "args", "params", "parameter", "format", "json", "schema", "browser", "search", "bash", "python", "final_answer")
DRIFT = ("need to", "should", "let me", "next", "then", "instead", "verify", "double-check", "rethink", "plan")
NEAR = f"""fl AS (SELECT *, type = 'Error' OR {hit('content', FAILS)} > 0 AS fails FROM sn), eb AS (SELECT trace_id, source AS a, target AS b, edge_type, true AS fwd FROM so UNION ALL SELECT trace_id, target, source, edge_type, false FROM so),
  nb AS (SELECT a.trace_id, a.node_id, a.fails OR coalesce(bool_or(z.fails), false) AS near_failure, {hit('any_value(a.content)', AGAIN)} > 0 OR coalesce(bool_or(e.edge_type = 'Retry'), false) AS is_retry,
    coalesce(a.type = 'Planning' AND bool_or(e.fwd AND z.type = 'Action') OR a.type = 'Action' AND bool_or(NOT e.fwd AND z.type = 'Planning'), false) AS is_bridge
    FROM fl a LEFT JOIN eb e ON e.trace_id = a.trace_id AND e.a = a.node_id LEFT JOIN fl z ON z.trace_id = a.trace_id AND z.node_id = e.b GROUP BY a.trace_id, a.node_id, a.fails, a.type)"""
PACK = """pack AS (
    SELECT trace_id, 0::BIGINT AS r, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS item FROM (SELECT DISTINCT trace_id FROM gn)
    UNION ALL SELECT p.trace_id, k.r, CASE WHEN p.n < {most} AND p.used + k.size <= {room} THEN p.used + k.size ELSE p.used END, CASE WHEN p.n < {most} AND p.used + k.size <= {room} THEN p.n + 1 ELSE p.n END, CASE WHEN p.n < {most} AND p.used + k.size <= {room} THEN k.node_id END
    FROM pack p JOIN rk k ON k.trace_id = p.trace_id AND k.r = p.r + 1)"""
ENDS = "en AS (SELECT trace_id, node_id FROM (SELECT *, max(ord) OVER w AS l, bool_or(type = 'Conclusion') OVER w AS a FROM gn WINDOW w AS (PARTITION BY trace_id)) WHERE type = 'Conclusion' OR (NOT a AND ord = l))"
MUST = "row_number() OVER (PARTITION BY trace_id ORDER BY must DESC, CASE WHEN must AND type = 'Conclusion' THEN 0 ELSE 1 END, CASE WHEN must THEN -ord END, rank, ord)"
THOUGHT = "th AS (SELECT trace_id, node_id AS source, lead(node_id, 2) OVER (PARTITION BY trace_id ORDER BY ord) AS target, ord FROM gn QUALIFY ord % 4 != 1 AND target IS NOT NULL)"
GTERMS = TF.replace("FROM cn)", "FROM gn)").replace("JOIN cn USING (trace_id, node_id) WHERE cn.type", "JOIN gn USING (trace_id, node_id) WHERE gn.type").replace("FROM cn) CROSS", "FROM gn) CROSS")
TARGETS = """tg AS (SELECT trace_id, coalesce(max(ord) FILTER (type = 'Conclusion'), max(ord) FILTER (type = 'Error'), max(ord)) AS ord FROM gn GROUP BY 1), tt AS (SELECT gn.trace_id, gn.node_id FROM gn JOIN tg ON tg.trace_id = gn.trace_id AND tg.ord = gn.ord)"""
CONFIDENCE = "CASE edge_type WHEN 'Temporal' THEN 0.25 WHEN 'Observation' THEN 0.75 * 0.85 + 0.25 * score ELSE 0.75 * 0.7 + 0.25 * score END"
ORACLE |= {
    "q_neighbourhoods": f"WITH {AGENT}, {NEAR} SELECT trace_id, node_id, near_failure, is_retry, is_bridge FROM nb",
    "q_suspicion": f"""WITH {AGENT}, {NEAR} SELECT sn.trace_id, sn.node_id,
      round(saliency + CASE type WHEN 'Error' THEN 5.0 WHEN 'Conclusion' THEN 4.2 WHEN 'Action' THEN 3.3 WHEN 'Planning' THEN 3.0 ELSE 1.8 END::DOUBLE + least(3.0, {hit('content', FAILS)} * 0.65::DOUBLE) + least(1.8, {hit('content', TOOLS)} * 0.18::DOUBLE) + least(1.2, {hit('content', DRIFT)} * 0.25::DOUBLE) + least(1.0, {hit('content', AGAIN)} * 0.4::DOUBLE)
        + CASE WHEN is_retry THEN 1.8 ELSE 0 END::DOUBLE + CASE WHEN near_failure THEN 1.2 ELSE 0 END::DOUBLE + CASE WHEN is_bridge THEN 0.8 ELSE 0 END::DOUBLE, 4) AS base_score,
      CASE WHEN {hit('content', ('format', 'schema', 'invalid', 'missing required tag', 'kwargs'))} > 0 THEN 'format_or_tool_argument_error' WHEN is_retry THEN 'retry_or_recovery_failure' WHEN type = 'Error' OR {hit('content', FAILS)} > 0 THEN 'tool_or_execution_failure'
        WHEN type = 'Fact' AND {hit('content', ('search', 'result', 'evidence', 'retrieved', 'google', 'web'))} > 0 THEN 'wrong_or_low_quality_evidence_used' WHEN type = 'Planning' THEN 'unsupported_or_invalid_reasoning' WHEN type = 'Action' THEN 'wrong_action_or_tool_choice' WHEN type = 'Conclusion' THEN 'final_answer_symptom' ELSE 'agent_trace_failure' END AS cause_type,
      CASE WHEN type = 'Action' THEN 'editor' ELSE '' END AS tool,
      len(list_distinct(list_filter(list_transform(regexp_extract_all(content, '[A-Za-z0-9_\\-/]{{3,}}'), lambda x: lower(x)), lambda x: NOT list_contains(['the','and','for','with','that','this','from','into','then','have','has','had','will','need','tool','args','params','output','input','message','step','final','answer'], x)))) AS n_words,
      least(1.0, {hit('content', ('error', 'failed', 'invalid', 'wrong', 'incorrect', 'unsupported', 'hallucinat', 'irrelevant', 'not found', 'missing', 'no evidence', 'contradict', 'timeout', 'exception'))} * 0.2::DOUBLE) AS doubt
      FROM sn JOIN nb ON nb.trace_id = sn.trace_id AND nb.node_id = sn.node_id""",
    "q_produced_faults": f"""WITH {AGENT}, m AS (SELECT *, span_id % 7 AS a FROM gn WHERE type = 'Action'), u AS (SELECT *, span_id % 7 AS a FROM gn WHERE type IN ('Error', 'Fact')),
      c AS (SELECT m.trace_id, m.node_id, m.ord, m.content, min(u.ord) AS then_ FROM m LEFT JOIN u ON u.trace_id = m.trace_id AND u.a = m.a AND u.ord > m.ord GROUP BY ALL),
      x AS (SELECT c.trace_id, c.node_id AS producer, c.ord, k.node_id AS consumer, CASE WHEN k.type = 'Error' THEN k.node_id ELSE (SELECT arg_min(z.node_id, z.ord) FROM gn z WHERE z.trace_id = c.trace_id AND z.type = 'Error' AND z.ord > k.ord) END AS error,
        EXISTS (SELECT 1 FROM m WHERE m.trace_id = c.trace_id AND m.a = c.node_id % 7 AND m.ord < c.ord) AS earlier, contains(c.content, 'stale') AS bad FROM c LEFT JOIN gn k ON k.trace_id = c.trace_id AND k.ord = c.then_),
      y AS (SELECT *, CASE WHEN consumer IS NOT NULL THEN 'upstream_state_producer' ELSE 'possible_state_producer' END AS role, round(1.0::DOUBLE + CASE WHEN bad THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN consumer IS NOT NULL THEN 0.9 ELSE 0 END::DOUBLE + CASE WHEN error IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE + 0.15::DOUBLE - CASE WHEN earlier THEN 0.55 ELSE 0 END::DOUBLE, 4) AS score FROM x)
      SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, role DESC, ord) AS INTEGER) AS rank, producer, role, consumer, error, score FROM y QUALIFY rank <= 12""",
    "q_tool_frequencies": f"WITH {AGENT} SELECT trace_id, 'editor' AS tool, count(*) AS n FROM gn WHERE type = 'Action' GROUP BY 1",
    "q_diagnosis_targets": f"WITH {AGENT}, {TARGETS} SELECT trace_id, 1 AS place, node_id FROM tt",
    "q_failure_slice": f"""WITH RECURSIVE {AGENT}, {NEAR}, {TARGETS}, ce AS (SELECT so.*, {CONFIDENCE} >= 0.65 AS sure, nb.near_failure OR nb.is_retry OR nb.is_bridge AS odd, nb.near_failure OR nb.is_retry AS very FROM so JOIN nb ON nb.trace_id = so.trace_id AND nb.node_id = so.source),
      ex AS (SELECT trace_id, node_id, 0 AS depth FROM tt UNION SELECT ex.trace_id, ce.source, least(ex.depth + 1, 5) FROM ex JOIN ce ON ce.trace_id = ex.trace_id AND ce.target = ex.node_id WHERE sure OR depth > 0 AND (very OR odd AND depth <= 4) OR depth = 0 AND false)
      SELECT trace_id, node_id FROM (SELECT trace_id, node_id FROM ex UNION SELECT tt.trace_id, so.source FROM tt JOIN so ON so.trace_id = tt.trace_id AND so.target = tt.node_id)""",
    "q_strategy_bm25": f"""WITH RECURSIVE {AGENT}, {ENDS}, {GTERMS}, c AS (SELECT trace_id, count(*) AS n, avg(len) AS mean FROM len GROUP BY 1),
      s AS (SELECT tf.trace_id, tf.node_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf.tf * 2.5::DOUBLE) / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * (1 + ln(qtf))), 4) AS score
        FROM tf JOIN q USING (trace_id, term) JOIN df USING (trace_id, term) JOIN c USING (trace_id) JOIN len USING (trace_id, node_id) GROUP BY ALL),
      o AS (SELECT gn.*, en.node_id IS NOT NULL AS must, row_number() OVER (PARTITION BY gn.trace_id ORDER BY coalesce(score, 0) DESC, ord DESC) AS rank FROM gn LEFT JOIN s ON s.trace_id = gn.trace_id AND s.node_id = gn.node_id LEFT JOIN en ON en.trace_id = gn.trace_id AND en.node_id = gn.node_id),
      rk AS (SELECT trace_id, node_id, length(content) AS size, {MUST} AS r FROM o), {PACK.format(most=80, room=14000)} SELECT trace_id, item AS node_id FROM pack WHERE item IS NOT NULL""",
    "q_strategy_window": f"""WITH RECURSIVE {AGENT}, {ENDS}, a AS (SELECT gn.trace_id, gn.ord FROM gn JOIN en ON en.trace_id = gn.trace_id AND en.node_id = gn.node_id),
      w AS (SELECT gn.trace_id, gn.node_id, gn.ord, min(abs(gn.ord - a.ord)) AS distance FROM gn JOIN a ON a.trace_id = gn.trace_id GROUP BY ALL HAVING min(abs(gn.ord - a.ord)) <= 8),
      o AS (SELECT gn.*, w.distance = 0 AS must, row_number() OVER (PARTITION BY gn.trace_id ORDER BY distance, gn.ord DESC) AS rank FROM gn JOIN w ON w.trace_id = gn.trace_id AND w.node_id = gn.node_id),
      rk AS (SELECT trace_id, node_id, length(content) AS size, {MUST} AS r FROM o), {PACK.format(most=20, room=600)} SELECT trace_id, item AS node_id FROM pack WHERE item IS NOT NULL""",
    "q_subgraph_summary": f"""WITH {AGENT}, {ENDS}, od AS (SELECT trace_id, node_id FROM sn QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY round(saliency + {BONUS} + CASE WHEN type = 'Error' THEN 2.0::DOUBLE ELSE 0.0 END, 4) DESC, node_id DESC) <= 10),
      n AS (SELECT gn.trace_id, count(*) AS alln, count(*) FILTER (ord % 3 = 0) AS k, coalesce(sum(length(content)) FILTER (ord % 3 = 0), 0) AS chars, count(en.node_id) AS es, count(en.node_id) FILTER (ord % 3 = 0) AS e, count(od.node_id) AS os, count(od.node_id) FILTER (ord % 3 = 0) AS o
        FROM gn LEFT JOIN en ON en.trace_id = gn.trace_id AND en.node_id = gn.node_id LEFT JOIN od ON od.trace_id = gn.trace_id AND od.node_id = gn.node_id GROUP BY 1),
      e AS (SELECT ge.trace_id, count(*) AS alle, count(*) FILTER (a.ord % 3 = 0 AND b.ord % 3 = 0) AS ke FROM ge JOIN gn a ON a.trace_id = ge.trace_id AND a.node_id = ge.source JOIN gn b ON b.trace_id = ge.trace_id AND b.node_id = ge.target GROUP BY 1)
      SELECT trace_id, k AS node_count, coalesce(ke, 0) AS edge_count, round(k::DOUBLE / alln, 4) AS node_ratio, round(coalesce(ke, 0)::DOUBLE / greatest(coalesce(alle, 0), 1), 4) AS edge_ratio, greatest(CAST(floor(chars / 4) AS BIGINT), 1) AS estimated_tokens, round(e.e::DOUBLE / greatest(es, 1), 4) AS anchor_coverage, round(o::DOUBLE / greatest(os, 1), 4) AS anomaly_coverage FROM (SELECT * FROM n LEFT JOIN e USING (trace_id)) e""",
    "q_packed_slice": f"""WITH RECURSIVE {AGENT}, {ENDS}, s AS (SELECT trace_id, node_id, 0 AS run, 0 AS hops FROM en UNION SELECT s.trace_id, e.source, CASE WHEN e.edge_type = 'Temporal' THEN s.run + 1 ELSE 0 END, s.hops + 1 FROM s JOIN ge e ON e.trace_id = s.trace_id AND e.target = s.node_id WHERE s.hops < 4 AND CASE WHEN e.edge_type = 'Temporal' THEN s.run + 1 ELSE 0 END <= 2),
      h AS (SELECT trace_id, node_id, min(hops) AS hops FROM s GROUP BY ALL), a AS (SELECT trace_id, count(*) AS n FROM h WHERE hops = 0 GROUP BY 1),
      r AS (SELECT h.*, a.n, row_number() OVER (PARTITION BY h.trace_id ORDER BY hops = 0 DESC, hops, saliency DESC, ord) AS r FROM h JOIN a ON a.trace_id = h.trace_id JOIN sn ON sn.trace_id = h.trace_id AND sn.node_id = h.node_id)
      SELECT trace_id, node_id, hops FROM r WHERE hops = 0 OR r <= 40""",
    "q_path_edges": f"WITH {AGENT}, p AS (SELECT trace_id, ord FROM (SELECT *, lead(node_id, 2) OVER (PARTITION BY trace_id ORDER BY ord) AS c FROM gn) WHERE ord % 5 = 0 AND c IS NOT NULL) SELECT ge.trace_id, source, target, edge_type FROM ge JOIN gn a ON a.trace_id = ge.trace_id AND a.node_id = ge.source JOIN gn b ON b.trace_id = ge.trace_id AND b.node_id = ge.target WHERE b.ord = a.ord + 1 AND EXISTS (SELECT 1 FROM p WHERE p.trace_id = ge.trace_id AND a.ord - p.ord IN (0, 1))",
    "q_graph_signals": f"""WITH {AGENT}, {THOUGHT}, c AS (SELECT th.trace_id, count(*) FILTER (a.type = 'Fact' AND b.type = 'Conclusion') AS support FROM th JOIN gn a ON a.trace_id = th.trace_id AND a.node_id = th.source JOIN gn b ON b.trace_id = th.trace_id AND b.node_id = th.target GROUP BY 1),
      e AS (SELECT ge.trace_id, count(*) FILTER (edge_type = 'Retry') AS retry_edges, count(*) FILTER (edge_type = 'Observation') AS observation_edges, count(*) FILTER (edge_type = 'Observation' AND contains(b.content, 'failed')) AS failed_observations FROM ge JOIN gn b ON b.trace_id = ge.trace_id AND b.node_id = ge.target GROUP BY 1),
      n AS (SELECT sn.trace_id, count(*) FILTER (type = 'Conclusion') AS conclusions, count(*) FILTER (type = 'Fact' AND th.source IS NULL AND saliency >= 4) AS isolated_facts FROM sn LEFT JOIN th ON th.trace_id = sn.trace_id AND th.source = sn.node_id GROUP BY 1)
      SELECT trace_id, conclusions, coalesce(support, 0) AS fact_support, conclusions > 0 AND coalesce(support, 0) = 0 AS no_fact_support, coalesce(retry_edges, 0) AS retry_edges, coalesce(observation_edges, 0) AS observation_edges, coalesce(failed_observations, 0) AS failed_observations, isolated_facts, 0::BIGINT AS noise_support FROM n LEFT JOIN c USING (trace_id) LEFT JOIN e USING (trace_id)""",
    "q_salient_projection": f"""WITH {AGENT}, x AS (SELECT trace_id, source AS node_id, 1 AS o, 0 AS i FROM ge UNION ALL SELECT trace_id, target, 0, 1 FROM ge), dg AS (SELECT trace_id, node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY ALL)
      SELECT sn.trace_id, CAST(row_number() OVER (PARTITION BY sn.trace_id ORDER BY saliency DESC, ord) AS INTEGER) AS rank, sn.node_id, type, saliency, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, CAST(length(content) AS INTEGER) AS content_chars,
        CASE type WHEN 'Action' THEN 'has_number,has_tool' WHEN 'Error' THEN 'has_number,has_error_terms' WHEN 'Conclusion' THEN 'has_final_answer' ELSE 'has_number' END AS content_flags FROM sn LEFT JOIN dg ON dg.trace_id = sn.trace_id AND dg.node_id = sn.node_id QUALIFY rank <= 10""",
    "q_graph_digest": f"""WITH {AGENT}, {THOUGHT}, r AS (SELECT trace_id, count(*) AS retry_edges FROM ge WHERE edge_type = 'Retry' GROUP BY 1), t AS (SELECT trace_id, min(source) AS top_edge FROM th GROUP BY 1), m AS (SELECT trace_id, node_id AS top_node FROM sn QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY saliency DESC, ord) = 1),
      n AS (SELECT trace_id, count(*) AS n_nodes FROM gn GROUP BY 1) SELECT n.trace_id, n_nodes, coalesce(retry_edges, 0) AS retry_edges, top_node, top_edge FROM n JOIN m ON m.trace_id = n.trace_id LEFT JOIN r ON r.trace_id = n.trace_id LEFT JOIN t ON t.trace_id = n.trace_id""",
    "q_relocated_causes": f"""WITH {AGENT}, w AS (SELECT trace_id, ord, list_value({{'n': left(type, 1) || '_' || node_id, 'l': 's' || node_id, 't': type}}, lead({{'n': left(type, 1) || '_' || node_id, 'l': 's' || node_id, 't': type}}) OVER o, lead({{'n': left(type, 1) || '_' || node_id, 'l': 's' || node_id, 't': type}}, 2) OVER o) AS p FROM gn WINDOW o AS (PARTITION BY trace_id ORDER BY ord)),
      c AS (SELECT *, ord % 5 AS kind, list_filter(p, lambda x: x.t = 'Error')[1] AS err, list_filter(p, lambda x: x.t = 'Action')[1] AS act, list_filter(p, lambda x: x.t IN ('Planning', 'Conclusion'))[1] AS thought, list_filter(p, lambda x: x.t = 'Planning')[1] AS plan, list_filter(p, lambda x: x.t = 'Fact')[1] AS fact FROM w WHERE ord % 6 = 1 AND p[3] IS NOT NULL),
      k AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n, min(ord) OVER (PARTITION BY trace_id) AS first FROM c),
      a AS (SELECT trace_id, ord, n, first, CASE WHEN ord % 4 = 1 THEN p[2].n ELSE 'span' || ord END AS loc, ord % 4 = 1 AS known FROM k),
      z AS (SELECT a.trace_id, a.ord AS item, a.loc, k.p, k.kind, CASE WHEN k.ord IS NULL THEN NULL WHEN kind = 0 THEN coalesce(err, fact, p[1]).l WHEN kind = 1 THEN coalesce(act, plan, p[1]).l WHEN kind = 2 THEN p[3].l WHEN kind = 3 THEN coalesce(thought, p[1]).l ELSE p[1].l END AS l,
          CASE WHEN k.ord IS NULL THEN NULL WHEN kind = 0 THEN 'first_visible_error' WHEN kind = 1 THEN CASE WHEN act IS NOT NULL THEN 'bad_action_call' ELSE 'earliest_origin' END WHEN kind = 2 THEN 'final_symptom' ELSE 'earliest_origin' END AS rule
        FROM a LEFT JOIN k ON k.trace_id = a.trace_id AND k.ord = CASE WHEN a.known THEN a.ord WHEN a.n = 1 THEN a.first END)
      SELECT trace_id, item, loc AS original_location, coalesce(l, loc) AS location, rule, coalesce(l, loc) != loc AS moved FROM z""",
    "q_compact_chains": f"WITH {AGENT} SELECT trace_id, CAST(ord // 5 AS INTEGER) AS rank, node_id, type AS origin_type, type AS final_type, least(length(content), 180) AS usage_evidence_chars FROM gn WHERE ord % 5 = 0 AND ord // 5 <= 8",
    "q_prompt_pack": f"WITH {AGENT}, e AS (SELECT ge.trace_id, count(*) AS c FROM ge JOIN gn a ON a.trace_id = ge.trace_id AND a.node_id = ge.source JOIN gn b ON b.trace_id = ge.trace_id AND b.node_id = ge.target WHERE a.ord % 2 = 0 AND b.ord % 2 = 0 GROUP BY 1) SELECT gn.trace_id, count(*) AS node_count, coalesce(any_value(c), 0) AS edge_count, arg_min(length(content), ord) AS first_chars FROM gn LEFT JOIN e ON e.trace_id = gn.trace_id WHERE ord % 2 = 0 GROUP BY gn.trace_id",
    "q_graph_report": f"""WITH {AGENT}, c AS (SELECT trace_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (type = '{t}') AS {t.lower()}" for t in ("Intent", "Planning", "Action", "Fact", "Conclusion", "Error")) + f""" FROM gn GROUP BY 1), e AS (SELECT trace_id, count(*) AS m FROM ge GROUP BY 1),
      t AS (SELECT trace_id, string_agg('| ' || node_id || ' | ' || type || ' | ' || printf('%.4f', saliency) || ' | ' || replace(content, '|', '\\|') || ' |', chr(10) ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY saliency DESC, ord) AS r FROM sn) WHERE r <= 12 GROUP BY 1),
      w AS (SELECT trace_id, string_agg('- ' || node_id, chr(10) ORDER BY ord) AS wrong FROM gn WHERE type = 'Error' GROUP BY 1)
      SELECT c.trace_id, '# Trace ' || c.trace_id || chr(10) || chr(10) || '## Counts' || chr(10) || chr(10) || '- n_nodes: ' || n || """ + " || ".join(f"chr(10) || '- n_{t}: ' || {t}" for t in ("intent", "planning", "action", "fact", "conclusion", "error")) + """ || chr(10) || '- n_edges: ' || coalesce(m, 0) || chr(10) || chr(10) || '## Salient nodes' || chr(10) || chr(10) || '| node | type | saliency | text |' || chr(10) || '|-|-|-|-|' || chr(10) || top || chr(10) || chr(10) || '## Errors' || chr(10) || chr(10) || coalesce(wrong, 'none') || chr(10) AS report
      FROM c JOIN t ON t.trace_id = c.trace_id LEFT JOIN e ON e.trace_id = c.trace_id LEFT JOIN w ON w.trace_id = c.trace_id""",
    "q_subgraph_json": f"WITH {AGENT}, e AS (SELECT ge.trace_id, count(*) AS c FROM ge JOIN gn a ON a.trace_id = ge.trace_id AND a.node_id = ge.source JOIN gn b ON b.trace_id = ge.trace_id AND b.node_id = ge.target WHERE a.ord <= 9 AND b.ord <= 9 GROUP BY 1) SELECT gn.trace_id, 'first_nine' AS strategy, count(*) AS node_count, coalesce(any_value(c), 0) AS total_edges FROM gn LEFT JOIN e ON e.trace_id = gn.trace_id WHERE ord <= 9 GROUP BY gn.trace_id",
    "q_view_payload": f"""WITH {AGENT}, p AS (SELECT trace_id, CASE tool WHEN 'click' THEN 'tool' WHEN 'signup' THEN 'agent' ELSE 'planner' END AS part, ord FROM gn), f AS (SELECT trace_id, part, count(*) AS n FROM p GROUP BY ALL)
      SELECT gn.trace_id, any_value(content) FILTER (ord = 1) AS label, (SELECT part FROM p WHERE p.trace_id = gn.trace_id AND p.ord = 1) AS component, (SELECT arg_min(n, part) FROM f WHERE f.trace_id = gn.trace_id) AS n_first FROM gn GROUP BY gn.trace_id""",
    "q_batch_summary": f"WITH {PAIRS} SELECT human_impact, count(*) AS n, count(*) FILTER (item % 7 != 0) AS n_ok, round(avg(CASE WHEN item % 7 != 0 THEN (item % 10)::DOUBLE END), 4) AS mean_score FROM ju GROUP BY 1",
}

ORACLE["q_signatures"] = f"""SELECT doc_id, CAST(len({facts("coalesce(text, '')")}) AS BIGINT) AS n_signatures,
      CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\d{{4}}[-/年]\\d{{1,2}}[-/月]\\d{{1,2}}'))) AS BIGINT) AS n_dates, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '<[a-zA-Z_][a-zA-Z0-9_]*>'))) AS BIGINT) AS n_tags,
      regexp_matches(coalesce(text, ''), '(?i)final answer\\s*[:：]\\s*([^\\n]+)') AS answered FROM documents"""
EXTRACT = """xs AS (SELECT *, CASE WHEN t = 0 THEN 'CodeAgent.run' WHEN is_model THEN 'LiteLLMModel.__call__' ELSE 'tool' END AS name, CASE WHEN (c + t) % 13 = 0 THEN 'Error' ELSE 'Ok' END AS st,
    (c + t) % 13 = 0 OR (c + t) % 11 = 0 AND (c + t) % 7 != 0 AS bad FROM ss),
  xn AS (SELECT trace_id, span_id, t, 0 AS rule, 'Error' AS type, 'SpanError: ' || name AS content FROM xs WHERE st = 'Error'
    UNION ALL SELECT trace_id, span_id, t, 1, 'Intent', task FROM xs WHERE t = 0
    UNION ALL SELECT xs.trace_id, span_id, t, 1, CASE WHEN fa.final_id IS NOT NULL THEN 'Conclusion' ELSE 'Planning' END, output FROM xs LEFT JOIN fa ON fa.trace_id = xs.trace_id AND fa.final_id = xs.span_id WHERE is_model
    UNION ALL SELECT trace_id, span_id, t, 3, 'Action', 'Tool: lookup | Args: ' || arguments || ' | Params: ' || CASE WHEN c % 5 = 0 THEN '{"required":["url"]}' ELSE '{}' END FROM xs WHERE is_tool
    UNION ALL SELECT trace_id, span_id, t, 6, 'Fact', 'ToolResult: ' || result FROM xs WHERE is_tool AND result != ''
    UNION ALL SELECT trace_id, span_id, t, 7, 'Error', 'ToolResultError: ' || CASE WHEN contains(result, '"error"') THEN 'down' ELSE result END FROM xs WHERE is_tool AND result != '' AND bad)"""
ORACLE |= {
    "q_extracted_nodes": f"WITH {STEPS}, {FINALS}, {EXTRACT} SELECT trace_id, left(type, 1) || '_' || (row_number() OVER (PARTITION BY trace_id, type ORDER BY t, rule) - 1) AS node_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY t, rule) AS INTEGER) AS ord, type, md5(content) AS content_md5, span_id FROM xn",
    "q_suspicious_spans": "SELECT user_id AS trace_id, event_id AS span_id, CASE event_type WHEN 'error' THEN 'span_status_error' ELSE 'invalid_tool_kwargs' END AS kind FROM events WHERE event_type IN ('error', 'signup') UNION ALL SELECT user_id, event_id, 'step_output_error_keyword' FROM events WHERE event_type = 'error'",
    "q_dedup_provenance": f"""WITH {AGENT}, k AS (SELECT *, CASE WHEN type = 'Error' THEN CAST(span_id AS VARCHAR) ELSE 'a' || (ord % 2) END AS own FROM gn)
      SELECT trace_id, arg_min(node_id, ord) AS node_id, type, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT ord)), ',') AS source_steps FROM k GROUP BY trace_id, type, own, content""",
    "q_dataset_rows": "SELECT 'train' AS split, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS idx, CASE WHEN item_id % 3 = 0 THEN 'sample_' || lpad(CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR), 5, '0') ELSE CAST(item_id AS VARCHAR) END AS sample_id, md5(text) AS annotation_md5 FROM benchmark UNION ALL SELECT 'test', CAST(n - 1 AS INTEGER), CAST(region AS VARCHAR), NULL FROM (SELECT r_regionkey AS region, row_number() OVER (ORDER BY r_regionkey) AS n FROM region) WHERE n <= 3",
    "q_annotations": "SELECT CAST(n_nationkey AS VARCHAR) AS trace_id, CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'unreadable annotation' ELSE 'no annotation' END AS status FROM nation",
    "q_graph_files": "SELECT CAST(n_nationkey AS VARCHAR) AS trace_id, CASE n_nationkey % 3 WHEN 0 THEN 'local_' || n_nationkey || '_graph.json' WHEN 1 THEN 'a-' || n_nationkey || '.json' END AS file FROM nation",
    "q_graph_choice": "SELECT n_nationkey AS trace_id, CASE WHEN n_nationkey % 4 = 0 THEN 's' WHEN n_nationkey % 2 = 0 THEN 'p' ELSE 'f' END || n_nationkey AS graph, CASE WHEN n_nationkey % 4 = 0 THEN 'suspicious' WHEN n_nationkey % 2 = 0 THEN 'pruning' ELSE 'full' END AS graph_source FROM nation",
    "q_payload_split": "SELECT lpad(CAST(user_id AS VARCHAR), 32, '0') AS trace_id, count(*) AS n_spans, count(*) AS spans_in_payload FROM events GROUP BY 1",
    "q_payload_manifest": "SELECT lpad(CAST(user_id AS VARCHAR), 32, '0') AS trace_id, 1::BIGINT AS payloads, count(*) AS n_spans FROM events GROUP BY 1",
}

# --- evaluation, judging, layers

SCORED = f"""{PAIRS}, sc AS (SELECT trace_id, item, human_impact, auto_impact, CASE WHEN item % 2 = 0 THEN 'raw' ELSE 'graph' END AS source, item % 4 != 3 AS semantic, item % 4 != 3 AND exact AS ex, item % 4 != 3 AND (exact OR item % 3 = 0) AS ch, item % 4 != 3 AND exact AND human_impact = auto_impact AS st FROM ju)"""
COVERED = f"""{SCORED}, ho AS (SELECT trace_id, human_impact AS impact, count(*) AS human_total FROM ju GROUP BY ALL), hi AS (SELECT trace_id, source, human_impact AS impact, policy, count(*) FILTER (hit) AS matched FROM (
    SELECT *, 'semantic' AS policy, semantic AS hit FROM sc UNION ALL SELECT *, 'exact', ex FROM sc UNION ALL SELECT *, 'chain_aware', ch FROM sc UNION ALL SELECT *, 'strict', st FROM sc) GROUP BY ALL),
  ev AS (SELECT t.trace_id, s.source, p.policy, i.impact FROM (SELECT DISTINCT trace_id FROM ho) t CROSS JOIN (VALUES ('raw'), ('graph')) s(source) CROSS JOIN (VALUES ('semantic'), ('exact'), ('chain_aware'), ('strict')) p(policy) CROSS JOIN (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) i(impact)),
  co AS (SELECT trace_id, source, policy, CAST(sum(coalesce(human_total, 0)) AS BIGINT) AS human_total, CAST(sum(least(coalesce(matched, 0), coalesce(human_total, 0))) AS BIGINT) AS matched, round(avg(CASE WHEN coalesce(human_total, 0) > 0 THEN round(least(coalesce(matched, 0), human_total)::DOUBLE / human_total, 4) ELSE 1.0 END), 4) AS macro
    FROM ev LEFT JOIN ho USING (trace_id, impact) LEFT JOIN hi USING (trace_id, source, policy, impact) GROUP BY ALL),
  cv AS (SELECT trace_id, source, policy, human_total, matched, CASE WHEN human_total > 0 THEN round(matched::DOUBLE / human_total, 4) ELSE 0.0 END AS coverage, round(100 * CASE WHEN human_total > 0 THEN round(matched::DOUBLE / human_total, 4) ELSE 0.0 END, 2) AS coverage_percent, macro FROM co)"""
ASKED = "ak AS (SELECT conv_id || '-' || turn AS trace_id, turn, source FROM conversations CROSS JOIN (VALUES ('raw', 1), ('graph', 2), ('pure_graph', 3)) v(source, k) WHERE turn % k = 0)"
ORACLE |= {
    "q_normalised_pairs": f"WITH {SCORED} SELECT trace_id, item, source, semantic, ex AS exact, ch AS chain_aware, st AS strict FROM sc",
    "q_trace_coverage": f"WITH {COVERED} SELECT * FROM cv",
    "q_global_rates": f"WITH {COVERED} SELECT source, policy, count(*) AS traces, CAST(sum(human_total) AS BIGINT) AS human_total, CAST(sum(matched) AS BIGINT) AS matched, round(avg(coverage), 4) AS mean_coverage, round(avg(macro), 4) AS mean_macro, round(sum(matched)::DOUBLE / sum(human_total)::DOUBLE, 6) AS hit_rate FROM cv GROUP BY ALL",
    "q_evaluated": "SELECT n_nationkey AS trace_id, CASE WHEN n_nationkey % 5 != 0 THEN 'raw' END AS source, CASE WHEN n_nationkey % 5 = 0 THEN 'not judged' WHEN n_nationkey % 2 = 1 THEN 'no annotation' WHEN n_nationkey % 3 = 0 THEN 'judge failed' ELSE 'scored' END AS status FROM nation WHERE n_nationkey % 5 != 0 OR n_nationkey % 2 = 0",
    "q_matching_errors": """WITH c AS (SELECT n_regionkey AS trace_id, n_nationkey AS item, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 6 END AS loc, n_nationkey % 3 = 0 AS tool FROM nation),
      h AS (SELECT c.trace_id, c.item, min(n_nationkey) AS p FROM c JOIN nation ON n_regionkey = c.trace_id AND n_nationkey % 6 = c.loc GROUP BY ALL), m AS (SELECT c.trace_id, c.item, min(n_nationkey) AS p FROM c JOIN nation ON n_regionkey = c.trace_id AND c.tool AND n_nationkey % 4 = 0 GROUP BY ALL)
      SELECT trace_id, item, coalesce(h.p, m.p) AS error_place, CASE WHEN h.p IS NOT NULL THEN 'location' WHEN m.p IS NOT NULL THEN 'module' END AS matched_by FROM c LEFT JOIN h USING (trace_id, item) LEFT JOIN m USING (trace_id, item)""",
    "q_audit_rows": f"WITH {PAIRS} SELECT trace_id, item, CASE WHEN chain_aware THEN 'adjacent' WHEN a IS NULL THEN 'unknown' ELSE 'different' END AS relation FROM ju WHERE NOT exact",
    "q_token_limits": """WITH t AS (SELECT o_orderkey, o_orderkey * 37 % 200000 AS tokens, CASE WHEN o_orderkey % 2 = 0 THEN least(60000, 131072 - 2200 - 4096 - o_orderkey % 500) ELSE 131072 - 2200 - 4096 - o_orderkey % 500 END AS f FROM orders),
      s AS (SELECT *, greatest(512, least(f, tokens)) AS s, least(tokens, 8000) AS low FROM t), l AS (SELECT o_orderkey, f, tokens, s, list_distinct(list_filter([greatest(low, s // 2), greatest(low, s // 4), greatest(low, s // 8)], lambda x: x < s)) AS more FROM s)
      SELECT o_orderkey, f AS first, CASE WHEN tokens <= 0 THEN '0' ELSE array_to_string(list_concat([s], list_reverse_sort(more)), ',') END AS limits FROM l""",
    "q_judge_batch": f"WITH {ASKED} SELECT trace_id, source, true AS ok, 'w' || turn AS location, 1 AS tries FROM ak WHERE NOT (source = 'raw' AND turn = 0)",
    "q_judge_usage": f"WITH {ASKED}, u AS (SELECT source, count(*) AS n, CAST(count(*) * CASE source WHEN 'raw' THEN 10 WHEN 'graph' THEN 4 ELSE 1 END AS BIGINT) AS p FROM ak GROUP BY source) SELECT source, n, n AS n_ok, p AS prompt_tokens, round(((SELECT p FROM u WHERE source = 'raw') - p)::DOUBLE / (SELECT p FROM u WHERE source = 'raw'), 4) AS saving FROM u",
    "q_judge_checks": """WITH c("check") AS (VALUES ('task_understanding'), ('planning'), ('tool_selection'), ('tool_arguments'), ('tool_results'), ('evidence_use'), ('error_recovery'), ('format'), ('final_answer'))
      SELECT CAST(n_nationkey AS VARCHAR) AS trace_id, 'raw' AS source, c."check", CASE WHEN n_nationkey % 2 = 0 AND c."check" = 'planning' THEN 'fail' ELSE 'not_checked' END AS verdict FROM nation CROSS JOIN c WHERE n_nationkey % 5 != 0""",
    "q_diagnosis": "SELECT CAST(n_nationkey AS VARCHAR) AS trace_id, CASE WHEN n_nationkey % 3 = 0 THEN 's' || n_nationkey WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 100 AS VARCHAR) ELSE 'unknown' END AS location, CASE WHEN n_nationkey % 3 = 0 THEN 'said' WHEN n_nationkey % 2 = 0 THEN 'other' ELSE 'F4' END AS reason, CASE WHEN n_nationkey % 3 = 0 THEN 'judgement' WHEN n_nationkey % 2 = 0 THEN 'chain' ELSE 'rule' END AS basis FROM nation",
    "q_application_layer": f"""WITH {AGENT}, e AS (SELECT trace_id, count(*) AS edge_count FROM ge GROUP BY 1)
      SELECT gn.trace_id, count(*) AS span_count, count(*) FILTER (tool = 'signup') AS llm_calls, count(*) FILTER (tool != 'signup') AS tool_calls, count(*) FILTER (type = 'Error') AS failed_spans, count(*) AS node_count, count(*) FILTER (type = 'Error') AS error_nodes, coalesce(any_value(edge_count), 0) AS edge_count, CASE WHEN count(*) FILTER (type = 'Error') > 0 THEN 'critical' ELSE 'healthy' END AS status FROM gn LEFT JOIN e ON e.trace_id = gn.trace_id GROUP BY gn.trace_id""",
    "q_accelerator_flags": """WITH s AS (SELECT l_returnflag AS pod, l_suppkey AS device, CAST(l_linenumber % 4 AS INTEGER) AS m, arg_max(l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS v FROM lineitem GROUP BY ALL),
      w AS (SELECT pod, device, max(v) FILTER (m = 0) AS u, max(v) FILTER (m = 2) AS t, max(v) FILTER (m = 3) AS e FROM s GROUP BY ALL), g AS (SELECT pod, count(*) AS device_count, max(u) AS utilization_max, max(t) AS temperature_max, count(*) FILTER (e != 0) AS error_devices FROM w GROUP BY 1)
      SELECT *, array_to_string(list_filter([CASE WHEN utilization_max >= 95 THEN 'utilization_saturated' END, CASE WHEN temperature_max >= 85 THEN 'temperature_critical' END, CASE WHEN error_devices > 0 THEN 'device_error' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""",
    "q_scoped_samples": """WITH s AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'p' || user_id % 4 ELSE '' END AS pod, user_id % 10 AS dev FROM events), d AS (SELECT DISTINCT pod AS asked, dev FROM s WHERE pod != ''), r AS (SELECT pod AS asked, event_id FROM s WHERE pod != '' UNION SELECT asked, event_id FROM d JOIN s USING (dev))
      SELECT asked, 'pod' AS scope, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'gone', 'exporter', 0""",
    "q_host_status": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS system_id, p_size * 2.0 AS c, (p_partkey % 100)::DOUBLE AS m, CASE WHEN p_partkey % 9 != 0 THEN p_size + 50.0 END AS d FROM part),
      r AS (SELECT system_id, CASE WHEN c >= 95 THEN 3 WHEN c >= 80 THEN 2 ELSE 1 END AS c, CASE WHEN m >= 95 THEN 3 WHEN m >= 80 THEN 2 ELSE 1 END AS m, CASE WHEN d IS NULL THEN 0 WHEN d >= 95 THEN 3 WHEN d >= 85 THEN 2 ELSE 1 END AS d FROM p), n AS (SELECT ['unknown', 'ok', 'warning', 'critical'] AS n)
      SELECT system_id, n[c + 1] AS cpu_status, n[m + 1] AS memory_status, n[d + 1] AS disk_status, n[greatest(c, m, d) + 1] AS status FROM r CROSS JOIN n""",
}
LEXICAL = "len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_\\-/]{3,}'), lambda x: lower(x)), lambda x: NOT list_contains(['the','and','for','with','that','this','from','into','then','have','has','had','will','need','tool','args','params','output','input','message','step','final','answer'], x))))"
ORACLE["q_text_parts"] = f"""WITH RECURSIVE q AS (SELECT doc_id, left(text, 300) AS f FROM documents), sz AS (SELECT doc_id, f, unnest(range(0, 301)) AS n FROM q), ct AS (SELECT doc_id, f, n, left(f, CAST(floor(n * 2 / 3) AS INTEGER)) || chr(10) || '...[cut]...' || chr(10) || right(f, CAST(n - floor(n * 2 / 3) AS INTEGER)) AS cut FROM sz WHERE n < length(f)),
      es AS (SELECT doc_id, n, length(cut) AS chars, length(cut) AS len, length(regexp_replace(cut, '[^\\x00-\\x7f]', '', 'g')) AS asc_ FROM ct), ok AS (SELECT doc_id, n, chars, (asc_ + 2) // 3 + (len - asc_ + 1) // 2 <= 40 AS fits FROM es),
      best AS (SELECT doc_id, max(n) AS n FROM ok o WHERE fits AND NOT EXISTS (SELECT 1 FROM ok x WHERE x.doc_id = o.doc_id AND x.n < o.n AND NOT x.fits) GROUP BY doc_id),
      whole AS (SELECT doc_id, (length(regexp_replace(f, '[^\\x00-\\x7f]', '', 'g')) + 2) // 3 + (length(f) - length(regexp_replace(f, '[^\\x00-\\x7f]', '', 'g')) + 1) // 2 <= 40 AS fits, length(f) AS chars FROM q)
      SELECT d.doc_id, {LEXICAL} AS n_lexical, lang || '|' || array_to_string(list_filter(string_split(source, ' '), lambda x: x != ''), '|') || '|E_1' AS path, CASE WHEN lang = 'a' THEN 'a' ELSE 'a|' || lang END AS ids,
        md5(CASE WHEN length('{{"doc_id":' || d.doc_id || ',"lang":"' || lang || '"}}') > 20 THEN left('{{"doc_id":' || d.doc_id || ',"lang":"' || lang || '"}}', 20) || '...[truncated]' ELSE '{{"doc_id":' || d.doc_id || ',"lang":"' || lang || '"}}' END) AS dumped,
        md5(CASE WHEN d.doc_id % 2 = 0 THEN regexp_replace(source, '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(left(text, 300), '^\\s+|\\s+$', '', 'g') END) AS task, CAST(CASE WHEN whole.fits THEN whole.chars ELSE coalesce(best.n, 0) + 13 END AS INTEGER) AS cut_chars,
        CASE upper(left(lang, 1)) WHEN 'F' THEN 'Fact' WHEN 'E' THEN 'Error' WHEN 'I' THEN 'Intent' WHEN 'P' THEN 'Planning' WHEN 'A' THEN 'Action' WHEN 'C' THEN 'Conclusion' ELSE 'unknown' END AS kind, CASE WHEN d.doc_id IN (3, 5) THEN 'full' ELSE 'digest' END AS mode,
        1::BIGINT AS n_terms, d.doc_id % 2 = 0 AS tool_error, CASE WHEN d.doc_id % 3 = 0 THEN 'called with empty argument key in kwargs' ELSE 'expects empty params but received kwargs' END AS fault
      FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id JOIN whole ON whole.doc_id = d.doc_id"""
ORACLE["q_graph_json"] = f"""WITH {GRAPH}, n AS (SELECT trace_id, list(struct_pack(ord := ord, id := node_id, type := type, content := content) ORDER BY ord) AS nodes, count(*) AS c, """ + ", ".join(f"count(*) FILTER (type = '{t}') AS {t.lower()}" for t in ("Intent", "Planning", "Action", "Fact", "Conclusion", "Error")) + """ FROM gn GROUP BY 1),
      e AS (SELECT trace_id, list(struct_pack(source := source, target := target, edge_type := edge_type, score := score) ORDER BY source, target, edge_type) AS edges, count(*) AS m FROM ge GROUP BY 1),
      k AS (SELECT trace_id, map_from_entries(list((edge_type, c) ORDER BY edge_type)) AS kinds FROM (SELECT trace_id, edge_type, count(*) AS c FROM ge GROUP BY ALL) GROUP BY 1)
      SELECT n.trace_id, CAST(to_json(struct_pack(summary := struct_pack(total_nodes := c, total_edges := coalesce(m, 0), node_types := struct_pack(Intent := intent, Planning := planning, Action := action, Fact := fact, Conclusion := conclusion, Error := error), edge_types := coalesce(kinds, MAP {})), nodes := nodes, edges := coalesce(edges, []))) AS VARCHAR) AS graph
      FROM n LEFT JOIN e ON e.trace_id = n.trace_id LEFT JOIN k ON k.trace_id = n.trace_id"""
ORACLE |= {
    "q_inferred_scopes": f"""WITH RECURSIVE {ES}, up AS (SELECT trace_id, span_id, parent_id AS anc, 1 AS dist FROM es WHERE parent_id IS NOT NULL UNION ALL SELECT up.trace_id, up.span_id, e.parent_id, up.dist + 1 FROM up JOIN es e ON e.trace_id = up.trace_id AND e.span_id = up.anc WHERE e.parent_id IS NOT NULL),
      rn AS (SELECT trace_id, span_id, pos FROM es WHERE tool = 'signup' AND span_id % 2 = 0), sw AS (SELECT trace_id, span_id, pos FROM es WHERE tool = 'signup' AND span_id % 2 = 1),
      cl AS (SELECT s.trace_id, s.span_id AS spawn, any_value(s.pos) AS pos, arg_min(r.span_id, (up.dist, r.pos)) AS run FROM sw s JOIN up ON up.trace_id = s.trace_id AND up.anc = s.span_id JOIN rn r ON r.trace_id = up.trace_id AND r.span_id = up.span_id GROUP BY s.trace_id, s.span_id),
      bg AS (SELECT trace_id, run, arg_max(spawn, pos) AS spawn FROM cl GROUP BY ALL), ab AS (SELECT trace_id, span_id, anc, dist FROM up UNION ALL SELECT trace_id, span_id, span_id, 0 FROM es),
      nr AS (SELECT ab.trace_id, ab.span_id, arg_min(anc, dist) AS near FROM ab JOIN bg ON bg.trace_id = ab.trace_id AND bg.run = ab.anc GROUP BY ALL), tp AS (SELECT ab.trace_id, ab.span_id, arg_max(anc, dist) AS top FROM ab JOIN rn ON rn.trace_id = ab.trace_id AND rn.span_id = ab.anc GROUP BY ALL),
      ow AS (SELECT es.trace_id, es.span_id, coalesce(near, top) AS agent, near IS NOT NULL AS sub FROM es LEFT JOIN nr ON nr.trace_id = es.trace_id AND nr.span_id = es.span_id LEFT JOIN tp ON tp.trace_id = es.trace_id AND tp.span_id = es.span_id),
      pa AS (SELECT bg.trace_id, bg.run, bg.spawn, ow.agent AS parent FROM bg JOIN ow ON ow.trace_id = bg.trace_id AND ow.span_id = bg.spawn),
      dp AS (SELECT trace_id, run, parent AS spot, 1 AS depth FROM pa WHERE parent IS NOT NULL UNION ALL SELECT dp.trace_id, dp.run, pa.parent, dp.depth + 1 FROM dp JOIN pa ON pa.trace_id = dp.trace_id AND pa.run = dp.spot WHERE pa.parent IS NOT NULL),
      dm AS (SELECT trace_id, run, max(depth) AS depth FROM dp GROUP BY ALL)
      SELECT ow.trace_id, ow.span_id, CAST(agent AS VARCHAR) AS agent_id, CASE WHEN sub THEN 'subagent' ELSE 'main' END AS agent_role, CASE WHEN sub THEN coalesce(depth, 0) ELSE 0 END AS agent_depth, pa.parent AS parent_agent_id, pa.spawn AS spawn_span_id
      FROM ow LEFT JOIN pa ON pa.trace_id = ow.trace_id AND pa.run = ow.agent LEFT JOIN dm ON dm.trace_id = ow.trace_id AND dm.run = ow.agent""",
    "q_virtualization": """WITH e AS (SELECT user_id AS trace_id, user_id % 4 AS k, event_type, event_id FROM events), f AS (SELECT trace_id, any_value(k) AS k, count(DISTINCT event_type) AS n FROM e GROUP BY 1)
      SELECT trace_id, CASE k WHEN 0 THEN 'Kubernetes' WHEN 1 THEN 'Cloud VM' WHEN 2 THEN 'Host/VM' ELSE 'unknown' END AS runtime, CAST(CASE WHEN k < 2 THEN n ELSE 0 END AS BIGINT) AS services, CAST(CASE WHEN k = 0 THEN 1 ELSE 0 END AS BIGINT) AS containers, CAST(CASE k WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS attributes, CASE WHEN k = 3 THEN 'unknown' ELSE 'healthy' END AS status FROM f""",
    "q_uploads": "WITH n AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS path, CASE WHEN n_nationkey >= 20 THEN 'more than 20 files' WHEN n_nationkey % 3 = 2 THEN 'empty file' WHEN n_nationkey % 3 = 1 THEN 'no JSON' END AS error FROM nation) SELECT path, error IS NULL AS ok, error FROM n",
    "q_exported_graphs": f"WITH {GRAPH}, e AS (SELECT trace_id, count(*) AS edges, round(sum(score), 4) AS score FROM ge GROUP BY 1) SELECT gn.trace_id, count(*) AS nodes, CAST(arg_max(node_id, ord) AS VARCHAR) AS last, any_value(edges) AS edges, any_value(score) AS score FROM gn LEFT JOIN e ON e.trace_id = gn.trace_id GROUP BY gn.trace_id",
    "q_diagnostic_report": """SELECT CAST(k AS VARCHAR) AS trace_id, '# Diagnosis of trace ' || k || chr(10) || chr(10) || '- severity: ' || CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'unknown' END || chr(10)
        || CASE WHEN k % 2 = 0 THEN chr(10) || '## Root causes' || chr(10) || chr(10) || '| location | impact | reason |' || chr(10) || '|-|-|-|' || chr(10) || '| s1-' || k || ' | LOW | a\\|b |' || chr(10) || '| s2-' || k || ' | HIGH | a\\|b |' || chr(10) ELSE '' END
        || CASE WHEN k % 3 = 0 THEN chr(10) || '## Causal chains' || chr(10) || chr(10) || '1. ' || k || ' -> ' || (k + 1) || ' (0.5000)' || chr(10) ELSE '' END
        || CASE WHEN k % 5 = 0 THEN chr(10) || '## Rule findings' || chr(10) || chr(10) || '| fault | name | confidence |' || chr(10) || '|-|-|-|' || chr(10) || '| F4 | Execution crash | 0.98 |' || chr(10) ELSE '' END AS report
      FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 5 = 0)""",
}
