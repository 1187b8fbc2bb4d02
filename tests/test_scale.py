"""What keeps queries within time and memory on larger tables: less work for the same results."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import graph, graph_algorithms, ranking, selection, spans, suspicion, target_paths
from spanloom.plans import catalog
from test_paths import random_trace


@pytest.mark.parametrize("only", ["targets", "slice"])
def test_targets_and_slice_need_no_ranking(only, monkeypatch):
    nodes, edges = random_trace(3)
    want = target_paths.Trail(nodes, edges, target_paths.Limits()).select()
    monkeypatch.setattr(target_paths.Trail, "ranking", lambda *a: pytest.fail("ranked"))
    monkeypatch.setattr(target_paths.Trail, "reached", lambda *a, **k: pytest.fail("a walk for each node"))
    got = target_paths.Trail(nodes, edges, target_paths.Limits()).select(only)
    assert got["targets"] == want["targets"]
    assert (got["slice"], got["counts"]) == ((want["slice"], want["counts"]) if only == "slice" else ([], {}))


def test_pairs_of_blocks_find_what_all_pairs_have(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    r = random.Random(5)
    words = [f"w{i:02d}" for i in range(9)]
    rows = [(t, 100 * t + i, i, r.choice(["Error", "Fact", "Action", None]), None if i == 7 else " ".join(r.sample(words, r.randrange(0, 5)))) for t in (1, 2) for i in range(15)]
    nodes = spark.createDataFrame(rows, "trace_id long, node_id long, ord int, type string, content string")
    want = []
    for t in (1, 2):
        mine, kept = [x for x in rows if x[0] == t], []
        for b in mine:
            pairs = []
            for a in mine[: b[2]]:
                x, y = set((a[4] or "").split()), set((b[4] or "").split())
                pairs.append((-round((len(x & y) / len(x | y) if x | y else 0.0) + 0.1 * (a[3] == "Error"), 6), b[2], a[2], a, b))
            kept += sorted(pairs, key=lambda p: p[:3])[:3]
        for s, _, _, a, b in sorted(kept, key=lambda p: p[:3])[:24]:
            if -s >= (0.04 if a[3] == "Error" and b[3] in ("Action", "Conclusion", "Planning") else 0.06):
                want.append((t, a[1], b[1], -s))
    got = graph.cognitive_edges(nodes)
    assert sorted((x.trace_id, x.source, x.target, x.score) for x in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_is_read_anew_for_each_row(spark):
    nodes = spark.createDataFrame([(1, i, i, "Error" if i == 3 else "Fact", f"read_text a{i % 2}.json") for i in range(6)], "trace_id long, node_id long, ord int, type string, content string")
    near = selection.temporal_window(nodes, F.col("type") == "Error", 2)
    assert sorted((x.node_id, x.distance) for x in near.collect()) == [(1, 2), (2, 1), (3, 0), (4, 1), (5, 2)]
    for rows in (near, suspicion.produced_faults(nodes)):
        plan = rows._jdf.queryExecution().analyzed().toString().lower()
        assert plan.count("unboundedfollowing") == plan.count("unboundedpreceding$(), unboundedfollowing")


def test_terms_are_counted_where_the_text_is(spark):
    said = ["The tool failed, the TOOL-kit_1 failed: not found", None, "", "the and for", "ΣΑΣ Tool\u0130x tool é1234", "tool " * 300]
    nodes = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "trace_id long, node_id long, content string")
    rows = selection.counted_terms(nodes)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {x.node_id: x.w for x in nodes.select("node_id", text.tokens(F.col("content")).alias("w")).collect()}
    got = rows.collect()
    for k, w in want.items():
        mine = [x for x in got if x.node_id == k]
        assert {x.term: x.tf for x in mine} == {"": len(w), **Counter(w)} and {x.len for x in mine} == {len(w)}


def test_lines_are_found_for_inner_spans_only(spark):
    r = random.Random(2)
    up = {i: (r.randrange(i) if i else None) for i in range(30)} | {40: 41, 41: 42, 42: 40, 43: 42, 44: 43, 50: 50, 51: 50, 52: 99}
    rows = spark.createDataFrame([(1, i, p) for i, p in up.items()], "trace_id long, span_id long, parent_id long")
    want = set()
    for i in up:
        at, seen = up[i], []
        while at is not None and at != i and at not in seen and not (up.get(i) == i):
            seen.append(at)
            at = up.get(at) if up.get(at) != at else None
        want |= {(i, a, d + 1) for d, a in enumerate(seen)}
    got = [(x.span_id, x.ancestor_id, x.dist) for x in spans.ancestors(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    inner = set(up.values())
    assert {x.span_id for x in spans.lines(rows).collect()} <= inner
    below = Counter(a for _, a, _ in want)
    assert {x.span_id: x.descendants for x in spans.descendants_count(rows).collect()} == below
    value = {i: "here" if i % 7 == 3 else None for i in up}
    near = spans.nearest_ancestor(rows, F.when(F.col("span_id") % 7 == 3, "here"), "task")
    nearest = {}
    for i, a, d in want:
        if value.get(a):
            nearest[i] = min(d, nearest.get(i, d))
    assert {x.span_id: x.dist for x in near.collect() if up.get(x.span_id) is not None and x.span_id < 40} == {k: d for k, d in nearest.items() if k < 40}


def test_token_estimates_take_out_runs(spark):
    said = ["plain words " * 9, "汉字 mixed é text " * 7, "ééé汉", "", None, "x" * 200]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "k long, t string")
    estimate = lambda t: sum("\u4e00" <= c <= "\u9fff" for c in t) + (sum(c < "\x80" for c in t) + 2) // 3 + (sum(not (c < "\x80" or "\u4e00" <= c <= "\u9fff") for c in t) + 1) // 2
    got = rows.select("k", text.token_estimate(F.col("t")).alias("n"), text.token_cut(F.col("t"), 20).alias("cut"))
    for x in got.collect():
        t = said[x.k] or ""
        cut = lambda n: t[: n * 2 // 3] + "\n...[cut]...\n" + (t[-(n - n * 2 // 3) :] if n else "")  # noqa: B023, E731
        room = 0
        for step in (1 << k for k in range(24, -1, -1)):
            room += step if room + step < len(t) and estimate(cut(room + step)) <= 20 else 0
        assert (x.n, x.cut) == (estimate(t), t if estimate(t) <= 20 else cut(room))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "x7f], " not in plan and "x7f]+, " in plan


def test_no_payload_holds_all_events(spark, tmp_path):
    events = spark.range(1000).selectExpr("id as event_id", "id % 500 as user_id", "'view' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert catalog._payloads(spark, str(tmp_path)).count() == 5
    got = catalog.QUERIES["q_payload_split"](spark, str(tmp_path)).collect()
    assert len(got) == 500 and {(x.n_spans, x.spans_in_payload) for x in got} == {(2, 2)}


def ladder(n):
    """A way over n squares: two equal ways around each, whose costs are no sums that doubles hold."""
    nodes = [{"node_id": k, "ord": k, "type": "Conclusion" if k == 3 * n else "Fact", "saliency": 5.0 if k == 0 else 1.0} for k in range(3 * n + 1)]
    edges = []
    for i in range(n):
        for a, z, c in ((0, 1, 0.1), (0, 2, 0.7), (1, 3, 0.7), (2, 3, 0.1)):
            edges.append({"source": 3 * i + a, "target": 3 * i + z, "edge_type": "Call", "confidence": 0.9, "dependency": "data", "causal_cost": c + i % 3 / 10})
    return nodes, edges


@pytest.mark.parametrize("back", [False, True])
def test_equal_paths_go_by_order(back, monkeypatch):
    nodes, edges = ladder(4)
    if back:  # an edge that leads back, so that a node at a time is looked at
        edges.append({**edges[0], "source": 12, "target": 0, "causal_cost": 9.0})
    want = [[0, *itertools.chain(*[(3 * i + 1 + x, 3 * i + 3) for i, x in enumerate(way)])] for way in itertools.product((0, 1), repeat=4)][:8]
    seen = []
    monkeypatch.setattr(ranking, "path_quality", lambda path, info, concluded: seen.append(path) or (0.9, 0.9, 1.0, 0.0))
    (best,) = [r for r in ranking.rank_trace(nodes, edges) if r[0] == 0]
    assert [p for p in seen if p[0] == 0] == want and best[6] == want[0]
    g = graph_algorithms.Graph(nodes, [{**e, "cost": round(e["causal_cost"] * 1e9)} for e in edges])
    assert g.led(0, 12, 8) == [p for _, p in g.paths(0, {12}, 8)] == want


def test_forward_graphs_take_one_pass_for_all_sources(monkeypatch):
    nodes, edges = ladder(6)
    monkeypatch.setattr(graph_algorithms.Graph, "shortest", lambda *a: pytest.fail("a search for each path"))
    monkeypatch.setattr(graph_algorithms.Graph, "paths", lambda *a: pytest.fail("a search for each source"))
    assert len(ranking.rank_trace(nodes, edges)) > 5


def test_traces_are_read_in_pieces():
    trace = [{"node_id": k, "words": ["a", f"w{k}"]} for k in range(60)]
    kind = pa.struct([("node_id", pa.int64()), ("words", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array([None if i % 7 == 0 else [] if i % 7 == 1 else trace for i in range(9000)], pa.list_(kind))], names=["trace_id", "nodes"])
    parts = list(graph_algorithms.pieces(iter([batch])))
    assert len(parts) > 2 and max(p.nbytes for p in parts) < 2 * graph_algorithms.PIECE
    assert [k for p in parts for k in p.column("trace_id").to_pylist()] == list(range(9000))
    assert [x for p in parts for x in graph_algorithms.of_traces(p, "nodes")] == [x or [] for x in batch.column("nodes").to_pylist()]
