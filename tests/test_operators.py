"""Operators on hand-written traces, and every query against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.operators import alignment, graph, graph_algorithms, ranking, reports, selection, spans, validation
from spanloom.plans.catalog import QUERIES
from spanloom.plans.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"
SPAN = "trace_id long, span_id long, parent_id long, pos int, tool string, input string, content string, status string, is_final boolean"


def trace(spark, *rows):
    return spark.createDataFrame([(1, i + 1, *r[:1], i + 1, *r[1:]) for i, r in enumerate(rows)], SPAN)


def test_faults_of_a_trace(spark):
    t = trace(spark, (None, "plan", "", "", "Ok", False), (1, "search", "{}", "malformed", "Error", False), (1, "search", "{}", "", "Error", False), (1, "search", "{}", "unknown tool x", "Ok", False), (1, "final", "", "done", "Ok", True))
    got = {r.fault_id: r.n_evidence for r in spans.fault_findings(t).collect()}
    assert got == {"F3": 3, "F10": 2, "F11": 2, "F12": 2, "F4": 2, "F8": 1, "F5": 1}
    calm = trace(spark, (None, "plan", "", "", "Ok", False), (1, "final", "", "done", "Ok", True))
    assert spans.fault_findings(calm).count() == 0


def test_ancestors_stop_at_cycles(spark):
    t = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 8, 9), (1, 9, 8), (1, 7, 7)], "trace_id long, span_id long, parent_id long")
    got = sorted((r.span_id, r.ancestor_id, r.dist) for r in spans.ancestors(t).collect())
    assert got == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (8, 9, 1), (9, 8, 1)]
    assert {r.span_id for r in spans.with_parent(t).where("is_root").collect()} == {1, 7}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 20, 4, 1, 1])], "trace_id int, k int, s int")
    got = [(r.item, r.place) for r in selection.budgeted(rows, [F.col("k")], F.col("k"), F.col("s"), 3, 10).orderBy("place").collect()]
    assert got == [(0, 1), (2, 2), (3, 3)]


def graph_of(n, edges):
    return graph_algorithms.Graph([{"node_id": i, "ord": i, "type": "Conclusion" if i == n - 1 else "Fact", "content": "w" * 10, "saliency": 1.0} for i in range(n)], [{"source": a, "target": b, "cost": c} for a, b, c in edges])


def test_paths_and_dominators_by_brute_force():
    import itertools
    import random

    r = random.Random(4)
    for _ in range(40):
        n = r.randrange(3, 8)
        edges = [(a, b, r.choice([0.5, 1.0, 1.5])) for a in range(n) for b in range(n) if a != b and r.random() < 0.4]
        g = graph_of(n, edges)
        cost = {(a, b): c for a, b, c in edges}
        every = sorted(sum(cost[x] for x in zip(p, p[1:], strict=False)) for k in range(n - 1) for m in itertools.permutations(range(1, n - 1), k) for p in [(0, *m, n - 1)] if all(x in cost for x in zip(p, p[1:], strict=False)))
        assert [round(c, 6) for c, _ in g.paths(0, {n - 1}, 5)] == [round(c, 6) for c in every[:5]]
        above = g.dominators(n - 1)
        for k in above:
            if k != n - 1:
                rest = graph_of(n, [e for e in edges if above[k] not in e[:2]]) if above[k] != n - 1 else None
                assert rest is None or rest.shortest(k, {n - 1}) is None


def test_strategies_respect_budgets(spark):
    nodes = spark.createDataFrame([(1, i, i, "Conclusion" if i == 9 else "Error" if i % 4 == 1 else "Fact", "x" * 50, 1.0 + i) for i in range(10)], "trace_id long, node_id long, ord int, type string, content string, saliency double")
    edges = spark.createDataFrame([(1, i, i + 1, "Temporal", 1.0) for i in range(9)], "trace_id long, source long, target long, edge_type string, score double")
    for name in graph_algorithms.STRATEGIES:
        kept = graph_algorithms.prune(nodes, edges, name, most=5, room=260).collect()
        assert 0 < len(kept) <= 5 and (name == "random_budget" or 9 in {r.node_id for r in kept})
    with pytest.raises(ValueError):
        graph_algorithms.prune(nodes, edges, "nope")
    strong = edges.withColumn("edge_type", F.lit("Cognitive"))
    ranked = ranking.root_causes(nodes, graph.typed_edges(strong, nodes))
    rows = ranked.orderBy("rank").collect()
    assert rows and all(r.path[0] == r.node_id and r.path[-1] == r.target == 9 and 0.55 <= r.final_dependency <= 1 for r in rows)
    assert ranking.diverse_chains(ranked).where("size(path) < 2").count() == 0


def test_locations_and_status(spark):
    df = spark.createDataFrame([("F_1", "see f_1"), ("F_1", "F_2"), ("Module A", "module a"), ("x", "unknown"), (None, "x")], "a string, b string")
    assert [r.m for r in df.select(alignment.location_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True, False, False]
    df = spark.createDataFrame([("OK", 'error: none'), ("STATUS_CODE_ERROR", ""), ("Ok", "request failed"), (None, None)], "s string, o string")
    assert [r.e for r in df.select(validation.result_status(F.col("s"), F.col("o"))["is_error"].alias("e")).collect()] == [False, True, True, False]


def test_judge_failures_stay_in_their_row(spark):
    digests = spark.createDataFrame([(1, "9,8", 5), (2, "", 0)], "trace_id long, suspicious string, errors long")
    rows = {r.trace_id: r for r in reports.judged(digests).collect()}
    assert rows["1"].ok and [(c.location, c.impact) for c in reports.root_cause_rows(reports.judged(digests)).collect()] == [("9", "HIGH")]

    def broken(prompt):
        raise RuntimeError("no answer")

    assert {(r.ok, r.error) for r in reports.judged(digests, broken).collect()} == {(False, "no answer")}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLE:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = c.sql(ORACLE[name])
    plain = lambda rows: Counter(str(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_mermaid_charts_whole_traces(spark):
    traces = {}
    for user, event, _ in sorted(spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "event_id", "ts").collect(), key=lambda r: (r.ts, r.event_id)):
        traces.setdefault(user, []).append(event)
    assert max(map(len, traces.values())) > 12
    charts = {r.trace_id: r.chart.split("\n")[1:] for r in QUERIES["q_mermaid"](spark, SMALL).collect()}
    assert charts.keys() == traces.keys()
    for user, ids in traces.items():
        assert [x.split("[")[0] for x in charts[user][: len(ids)]] == [f"  n{i}" for i in ids]
        assert sorted(charts[user][len(ids) :]) == sorted(f"  n{a} -->|Temporal| n{b}" for a, b in zip(ids, ids[1:], strict=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_descendants_of_all_levels(spark):
    read = lambda t, *c: spark.read.parquet(f"{SMALL}/{t}.parquet").select(*c).collect()
    above = {f"N{a}": f"R{b}" for a, b in read("nation", "n_nationkey", "n_regionkey")}
    above |= {f"C{a}": f"N{b}" for a, b in read("customer", "c_custkey", "c_nationkey")}
    above |= {f"O{a}": f"C{b}" for a, b in read("orders", "o_orderkey", "o_custkey")}
    want = Counter()
    for at in [*above.values(), *(f"O{r[0]}" for r in read("lineitem", "l_orderkey"))]:
        while at is not None:
            want[at] += 1
            at = above.get(at)
    assert {k[0] for k in want} == set("RNCO")
    assert {r.span_id: r.descendants for r in QUERIES["q_descendants"](spark, SMALL).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_digest_lists_suspicious_spans_beyond_the_fifth(spark):
    want = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        want.setdefault(r.user_id, []).extend([str(r.event_id)] * (r.event_type == "error"))
    assert 5 < max(map(len, want.values())) <= 80
    assert {r.trace_id: r.suspicious for r in QUERIES["q_digest"](spark, SMALL).collect()} == {k: ",".join(v) for k, v in want.items()}
