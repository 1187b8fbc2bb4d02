"""All ways to cut a graph to what a judge should see, under one name each and within the same budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.lineage import checkpointed
from spanloom.operators import graph_algorithms, selection, target_paths

NAMES = ("bm25_retrieval", "tfidf_retrieval", "temporal_window", "random_budget", "weighted_k_shortest_paths", "dominator_chain", "pcst_heuristic", "submodular_budget", "agenttrace_suspicious_paths", "anomaly_neighborhood", "rootcause_subgraph")
ALIASES = {"tg_spe": "agenttrace_suspicious_paths"}
#: Strategies that run a trace at a time.
PER_TRACE = {"random_budget": "random_budget", "weighted_k_shortest_paths": "k_shortest", "dominator_chain": "dominators", "pcst_heuristic": "steiner", "submodular_budget": "submodular"}


def known(names: tuple[str, ...]) -> tuple[str, ...]:
    """The names with aliases resolved; an unknown one is an error."""
    out = tuple(dict.fromkeys(ALIASES.get(n, n) for n in names))
    unknown = sorted(set(out) - set(NAMES))
    if unknown:
        raise ValueError(f"unknown pruning strategies: {', '.join(unknown)}; known: {', '.join((*NAMES, *ALIASES))}")
    return out


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)))


def pruned(nodes: DataFrame, edges: DataFrame, name: str, most: int = 80, room: int = 14_000) -> DataFrame:
    """What one strategy keeps of each trace (trace_id, node_id). Nodes have saliency; ids are whole numbers.

    Suspicious paths have no budget of their own, as they are short; all others keep to both.
    """
    (name,) = known((name,))
    ends = selection.anchors(nodes)
    if name in PER_TRACE:
        return graph_algorithms.prune(nodes, edges, PER_TRACE[name], most, room).select("trace_id", "node_id")
    if name == "rootcause_subgraph":
        return graph_algorithms.prune(nodes, edges, "k_shortest_10", min(70, most), room).select("trace_id", "node_id")
    if name == "agenttrace_suspicious_paths":
        return target_paths.listed(target_paths.found_paths(nodes, edges), "kept").select("trace_id", "node_id")
    if name == "anomaly_neighborhood":
        odd = selection.anomalies(nodes)
        near = selection.neighbourhood(odd, edges).join(nodes.select("trace_id", "node_id", "saliency", "ord"), ["trace_id", "node_id"])
        return selection.packed(nodes, _ranked(near, F.desc("saliency"), "ord"), odd, most, room).select("trace_id", "node_id")
    if name == "temporal_window":
        at = ends.select("trace_id", "node_id").withColumn("_end", F.lit(True))
        marked = nodes.join(at, ["trace_id", "node_id"], "left").withColumn("_end", F.coalesce("_end", F.lit(False)))
        near = selection.temporal_window(marked, F.col("_end"))
        return selection.packed(nodes, _ranked(near, "distance", F.desc("ord")), ends, most, room).select("trace_id", "node_id")
    score = (selection.bm25 if name == "bm25_retrieval" else selection.tfidf)(nodes, ends)
    every = nodes.select("trace_id", "node_id", "ord").join(score, ["trace_id", "node_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return selection.packed(nodes, _ranked(every, F.desc("score"), F.desc("ord")), ends, most, room).select("trace_id", "node_id")


def all_pruned(nodes: DataFrame, edges: DataFrame, names: tuple[str, ...] = NAMES, most: int = 80, room: int = 14_000) -> DataFrame:
    """What each of the strategies keeps (strategy, trace_id, node_id). Nodes and edges are written once; all strategies by trace share one pass."""
    names, nodes, edges = known(names), checkpointed(nodes), checkpointed(edges)
    shared = {n: (PER_TRACE[n], most) for n in names if n in PER_TRACE} | {n: ("k_shortest_10", min(70, most)) for n in names if n == "rootcause_subgraph"}
    out = graph_algorithms.prune_all(nodes, edges, shared, room).select("trace_id", "node_id", "strategy") if shared else None
    for name in (n for n in names if n not in shared):
        part = pruned(nodes, edges, name, most, room).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def summaries(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``selection.subgraph_summary`` of each strategy of ``all_pruned``."""
    out = None
    for name in NAMES:
        part = selection.subgraph_summary(nodes, edges, kept.where(F.col("strategy") == name)).where("node_count > 0").withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
