"""Ranking root causes: suspicious nodes, their best causal path to an outcome, and chains that differ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers
from spanloom.operators.graph_algorithms import Graph, of_traces, pieces, spread

# Weights of the parts of a root-cause score.
WEIGHTS = {"anomaly": 0.24, "semantic": 0.22, "dependency": 0.20, "strength": 0.16, "position": 0.09, "origin": 0.09}
RANKED = "trace_id long, rank int, node_id long, target long, score double, hops int, final_dependency double, strength double, path array<bigint>"


def _clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def path_quality(path: list[int], info: dict[tuple[int, int], dict], concluded: bool) -> tuple[float, float, float, float]:
    """final_dependency, strength, share of dependency edges and of temporal edges on a path."""
    edges = [info[p] for p in zip(path, path[1:], strict=False)]
    if not edges:
        return 0.0, 0.0, 0.0, 0.0
    real = [e["confidence"] for e in edges if e["dependency"] not in ("same_step_neighbor", "control_flow")]
    temporal = len([1 for e in edges if e["edge_type"] == "Temporal"]) / len(edges)
    ratio, mean = len(real) / len(edges), sum(real) / len(real) if real else 0.0
    strength = 0.65 * mean + 0.35 * min(real) if real else 0.35 * sum(e["confidence"] for e in edges) / len(edges)
    return round(_clamp(0.5 * ratio + 0.35 * mean + 0.1 * concluded - 0.2 * temporal), 4), strength, ratio, temporal


def rank_trace(nodes: list[dict], edges: list[dict], most: int = 12, longest: int = 18) -> list[tuple]:
    """Root causes of one trace: node, target, score, hops, final dependency, strength, path."""
    g = Graph(nodes, [{**e, "cost": round(e["causal_cost"] * 1e9)} for e in edges])  # whole numbers: equal sums are equal
    info: dict[tuple[int, int], dict] = {}
    for e in sorted(edges, key=lambda e: -e["causal_cost"]):
        info[e["source"], e["target"]] = e
    out = []
    targets = g.anchors()[::-1][:4]
    for k in g.anomalies(most):
        best = None
        for goal in targets:
            for path in g.led(k, goal, 8) if k != goal and g.steps(goal).get(k, longest + 1) <= longest else ():
                if len(path) - 1 > longest:
                    continue
                dep, strength, ratio, temporal = path_quality(path, info, g.nodes[goal]["type"] == "Conclusion")
                if dep >= 0.55 and strength >= 0.45 and (best is None or (dep, strength, ratio, -temporal, -len(path)) > best[0]):
                    best = ((dep, strength, ratio, -temporal, -len(path)), goal, path)
        if best is None:
            continue
        (dep, strength, *_), goal, path = best
        kind, hops = g.nodes[k]["type"], len(path) - 1
        anomaly = _clamp((g.prize(k) - 3) / 6)
        anomaly = max(anomaly, 0.85) if kind == "Error" else min(anomaly, 0.35) if kind == "Conclusion" else anomaly
        position = min(1.0, 0.2 + min(0.7, 0.12 * hops) + (0.1 if kind in ("Error", "Fact", "Action", "Planning") else 0.0))
        origin = 0.0 if kind == "Conclusion" else 0.25 + min(0.45, 0.08 * hops) + (0.18 if kind in ("Error", "Fact", "Action") else 0.1 if kind == "Planning" else 0.0)
        semantic = 1.0 if kind == "Error" else 0.0
        parts = {"anomaly": anomaly, "semantic": semantic, "dependency": dep, "strength": strength, "position": position, "origin": _clamp(origin)}
        out.append((k, goal, round(sum(WEIGHTS[p] * v for p, v in parts.items()), 4), hops, dep, round(strength, 4), path))
    return sorted(out, key=lambda r: (-r[2], -r[4], -r[5], -r[3], g.order[r[0]]))


def root_causes(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """RANKED rows of every trace, from nodes with saliency and ``graph.typed_edges``."""
    n = nodes.groupBy("trace_id").agg(F.collect_list(F.struct("node_id", "ord", "type", "saliency")).alias("nodes"))
    e = typed.groupBy("trace_id").agg(F.collect_list(F.struct("source", "target", "edge_type", "confidence", "dependency", "causal_cost")).alias("edges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            each = zip(batch.column("trace_id").to_pylist(), of_traces(batch, "nodes"), of_traces(batch, "edges"), strict=True)
            rows = [(trace, i + 1, *x) for trace, nodes, edges in each for i, x in enumerate(rank_trace(nodes, edges))]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in RANKED.split(", ")])

    return spread(n.join(e, "trace_id", "left")).mapInArrow(work, RANKED)


def diverse_chains(ranked: DataFrame, most: int = 5, a_target: int = 4, overlap: float = 0.85) -> DataFrame:
    """Of each trace, the best chains whose edges differ: a fold over the ranking (trace_id, rank, place, path)."""
    x = F.struct("rank", "target", "path", F.array_sort(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.concat_ws(">", F.get("path", i).cast("string"), F.get("path", i + 1).cast("string")))).alias("edges"))
    kind = "struct<rank:int,target:bigint,path:array<bigint>,edges:array<string>>"

    def step(acc, e):
        same = F.filter(acc, lambda k: k["target"] == e["target"])
        like = F.exists(acc, lambda k: F.size(F.array_intersect(k["edges"], e["edges"])) / F.greatest(F.size(e["edges"]), F.lit(1)) > overlap)
        return F.when((F.size(acc) < most) & (F.size(same) < a_target) & ~like, F.array_append(acc, e)).otherwise(acc)

    kept = ranked.groupBy("trace_id").agg(F.array_sort(F.collect_list(x)).alias("xs")).select("trace_id", F.posexplode(F.aggregate("xs", F.array().cast(f"array<{kind}>"), step)).alias("place", "c"))
    return kept.select("trace_id", F.col("c.rank").alias("rank"), (F.col("place") + 1).alias("place"), "c.path")


def producers(nodes: DataFrame, most: int = 12) -> DataFrame:
    """Of each trace, errors with the latest earlier call of the same tool as producer, best first: score, rank."""
    w = Window.partitionBy("trace_id", "tool").orderBy("ord")
    earlier = F.last(F.when(F.col("type") != "Error", F.col("node_id")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.count("*").over(Window.partitionBy("trace_id"))
    rows = nodes.withColumn("producer", earlier).withColumn("n", total).where("type = 'Error'")
    score = F.round(1 + 0.5 + F.when(F.col("producer").isNotNull(), -0.55).otherwise(0.0) + numbers.clamp(F.col("ord").cast("double") / F.col("n").cast("double")), 4)
    rows = rows.select("trace_id", F.col("node_id").alias("error_id"), "producer", score.alias("score"), "ord")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= most)
    return ranked.select("trace_id", "rank", "error_id", "producer", "score")
