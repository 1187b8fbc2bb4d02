"""Selecting parts of a graph: budgets, retrieval, slices and neighbourhoods, all as relational plans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers, text
from spanloom.lineage import checkpointed
from spanloom.operators.graph_algorithms import pieces


def budgeted(rows: DataFrame, order: list[Column], item: Column, size: Column, most: int, room: int) -> DataFrame:
    """Of each trace, items in order while fewer than ``most`` are taken; one that exceeds the room is skipped.

    A fold over the trace's sorted items, of which only number and size are held, and none that exceeds the room by itself.
    Returns trace_id, item, size, place (from 1).
    """
    w = Window.partitionBy("trace_id").orderBy(*order)
    ranked = rows.where(F.coalesce(size, F.lit(0)) <= room).select("trace_id", item.alias("item"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.row_number().over(w).alias("_r"))
    packed = ranked.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("_r", "item", "size"))).alias("xs"))
    kind = dict(ranked.dtypes)["item"]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<item:{kind},size:bigint>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) < most) & (acc["used"] + x["size"] <= room)
        taken = F.struct((acc["used"] + x["size"]).alias("used"), F.array_append(acc["kept"], F.struct(x["item"].alias("item"), x["size"].alias("size"))).alias("kept"))
        return F.when(fits, taken).otherwise(acc)

    return packed.select("trace_id", F.posexplode(F.aggregate("xs", start, step, lambda acc: acc["kept"])).alias("place", "x")).select("trace_id", "x.item", "x.size", (F.col("place") + 1).alias("place"))


def salient(nodes: DataFrame, most: int = 40, room: int = 18_000) -> DataFrame:
    """The most salient nodes within the budgets; equal ones by id as text, last first."""
    return budgeted(nodes, [F.desc("saliency"), F.desc(F.col("node_id").cast("string"))], F.col("node_id"), F.length("content"), most, room)


def anomalies(nodes: DataFrame, k: int = 6) -> DataFrame:
    """The k nodes of each trace with the highest saliency and type bonus, 2.0 more for errors; ties by id, last first."""
    score = F.round(F.col("saliency") + numbers.of(numbers.PRUNING_BONUS, F.col("type"), 1.0) + F.when(F.col("type") == "Error", 2.0).otherwise(0.0), 4)
    rows = nodes.withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), F.desc("node_id")))).where(F.col("rank") <= k).select("trace_id", "node_id", "score", "rank")


def anchors(nodes: DataFrame) -> DataFrame:
    """Outcome nodes: conclusions; where a trace has none, its last node."""
    last = F.max("ord").over(Window.partitionBy("trace_id"))
    any_ = F.max(F.when(F.col("type") == "Conclusion", 1).otherwise(0)).over(Window.partitionBy("trace_id"))
    return nodes.withColumn("_l", last).withColumn("_a", any_).where((F.col("type") == "Conclusion") | ((F.col("_a") == 0) & (F.col("ord") == F.col("_l")))).select("trace_id", "node_id", "ord", "content")


# What every search for the cause of an outcome asks for besides the outcome's own words.
FAILURE_TERMS = ("error", "failure", "failed", "invalid", "incorrect", "wrong", "exception", "timeout", "missing", "unsupported", "contradiction", "retry", "root", "cause")


def counted_terms(nodes: DataFrame) -> DataFrame:
    """Term frequencies of each node: trace_id, node_id, len (the node's length in terms), term, tf; and a row of each node with an empty term, whose tf is the length.

    A node's terms are counted where its text is, without a shuffle: the terms of ``text.tokens``.
    """
    token, stop = re.compile(text.TOKEN), frozenset(text.STOP_WORDS)
    kinds = dict(nodes.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, lens, words, counts = [], [], [], []
            for t in batch.column("low").to_pylist():
                found = Counter(token.findall(t))
                for w in stop & found.keys():
                    del found[w]
                total = found.total()
                sizes.append(len(found) + 1)
                lens.append(total)
                words += ["", *found]
                counts += [total, *found.values()]
            at = np.repeat(np.arange(batch.num_rows), sizes)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("trace_id", "node_id")], pa.array(np.asarray(lens, dtype=np.int32)[at] if sizes else [], pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["trace_id", "node_id", "len", "term", "tf"])

    low = nodes.select("trace_id", "node_id", F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    return low.mapInArrow(work, f"trace_id {kinds['trace_id']}, node_id {kinds['node_id']}, len int, term string, tf long")


def terms(nodes: DataFrame) -> DataFrame:
    """Term frequencies of each node: trace_id, node_id, term, tf, and the node's length in terms. Texts are cut into terms once, and written."""
    return checkpointed(counted_terms(nodes).where("term != ''"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms of each trace's query (trace_id, content) and the fixed failure terms, with their frequency."""
    told = queries.select("trace_id", F.explode(F.concat(text.tokens(F.col("content")))).alias("term"))
    asked = queries.select("trace_id").distinct().select("trace_id", F.explode(F.array(*[F.lit(t) for t in FAILURE_TERMS])).alias("term"))
    return told.unionByName(asked).groupBy("trace_id", "term").agg(F.count("*").alias("qtf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """Nodes of each trace that hold a term."""
    return tf.groupBy("trace_id", "term").agg(F.count("*").alias("df"))


def bm25(nodes: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Score of each node for its trace's query (trace_id, content) and the failure terms; nodes without such a term are left out.

    Only rows of query terms, and a node's length as the row of an empty one, are written and joined further: all nodes that hold
    such a term are among them, so its frequency is counted there.
    """
    asked = query_terms(queries)
    asked = asked.unionByName(asked.select("trace_id").distinct().select("trace_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("qtf")))
    every = checkpointed(counted_terms(nodes).join(asked, ["trace_id", "term"]))
    corpus = every.where("term = ''").groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("tf").alias("all")).select("trace_id", "n", (F.col("all") / F.col("n")).alias("mean"))
    hits = every.where("term != ''")
    rows = hits.join(document_frequencies(hits), ["trace_id", "term"]).join(corpus, "trace_id")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean"))) * (1 + F.ln("qtf"))
    return rows.groupBy("trace_id", "node_id").agg(F.round(F.sum(part), 4).alias("score"))


def tfidf(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of TF-IDF vectors of each node and its trace's query with the failure terms; nodes without such a term are left out."""
    tf = terms(nodes)
    n = nodes.groupBy("trace_id").agg(F.count("*").alias("n"))
    weighed = lambda t: (1 + F.ln(t)) * (F.ln((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    asked = query_terms(queries)
    doc = tf.join(document_frequencies(tf), ["trace_id", "term"]).join(n, "trace_id").withColumn("w", weighed(F.col("tf"))).join(asked, ["trace_id", "term"], "left")
    doc = doc.withColumn("q", F.when(F.col("qtf").isNotNull(), weighed(F.col("qtf"))))
    # one pass gives a node's norm and its product with the query; a term that no node holds counts in the query's norm alone
    known = doc.groupBy("trace_id", "node_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("dot is not null")
    query = asked.join(document_frequencies(tf), ["trace_id", "term"], "left").join(n, "trace_id").withColumn("q", weighed(F.col("qtf")))
    qnorm = query.groupBy("trace_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    return known.join(qnorm, "trace_id").select("trace_id", "node_id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 4).alias("score"))


def temporal_window(nodes: DataFrame, anchor: Column, reach: int = 8) -> DataFrame:
    """Nodes within ``reach`` places of an anchor, with the distance to the nearest.

    What follows is what precedes in falling order: a frame that ends with the trace would be read anew for each node.
    """
    last = lambda order: F.last(F.when(anchor, F.col("ord")), True).over(Window.partitionBy("trace_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    before, after = last(F.asc("ord")), last(F.desc("ord"))
    dist = F.least(F.col("ord") - before, after - F.col("ord"))
    return nodes.select("trace_id", "node_id", "ord", dist.alias("distance")).where(F.col("distance") <= reach)


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within ``hops`` edges of the seeds, either way, with the least number."""
    both = edges.select("trace_id", F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("trace_id", "target", "source")).distinct()
    level = seeds.select("trace_id", "node_id").distinct()
    out = level.withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        level = level.join(both, (level.trace_id == both.trace_id) & (F.col("node_id") == F.col("a"))).select(level.trace_id, F.col("b").alias("node_id")).distinct()
        out = out.union(level.withColumn("hops", F.lit(k)))
    return out.groupBy("trace_id", "node_id").agg(F.min("hops").alias("hops"))


def backward_slice(seeds: DataFrame, edges: DataFrame, hops: int = 4, most_temporal: int = 2) -> DataFrame:
    """Nodes from which a seed is reached in at most ``hops`` edges, with at most ``most_temporal`` temporal ones in a row."""
    e = edges.select("trace_id", "source", "target", (F.col("edge_type") == "Temporal").alias("temporal"))
    level = seeds.select("trace_id", "node_id", F.lit(0).alias("run")).distinct()
    out = level.select("trace_id", "node_id", F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        run = F.when(F.col("temporal"), F.col("run") + 1).otherwise(0)
        level = level.join(e, (level.trace_id == e.trace_id) & (F.col("node_id") == F.col("target"))).select(level.trace_id, F.col("source").alias("node_id"), run.alias("run")).where(F.col("run") <= most_temporal).distinct()
        out = out.union(level.select("trace_id", "node_id", F.lit(k).alias("hops")))
    return out.groupBy("trace_id", "node_id").agg(F.min("hops").alias("hops"))


def coverage(kept: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each trace: nodes, kept ones, their share, estimated tokens kept, and the share of errors kept."""
    both = nodes.join(kept.select("trace_id", F.col("item").alias("node_id"), F.lit(1).alias("k")), ["trace_id", "node_id"], "left")
    error = F.col("type") == "Error"
    out = both.groupBy("trace_id").agg(F.count("*").alias("n_nodes"), F.count("k").alias("n_kept"), F.sum(F.when(F.col("k") == 1, F.length("content")).otherwise(0)).alias("chars"), F.count_if(error).alias("n_errors"), F.count_if(error & (F.col("k") == 1)).alias("errors_kept"))
    ratio = lambda a, b: F.round(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double"), 4)
    return out.select("trace_id", "n_nodes", "n_kept", ratio("n_kept", "n_nodes").alias("node_ratio"), F.greatest(F.floor(F.col("chars") / 4), F.lit(1)).cast("long").alias("tokens"), ratio("errors_kept", "n_errors").alias("anomaly_coverage"))


def between(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of which both ends are kept (trace_id, node_id)."""
    ids = kept.select("trace_id", "node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "source"), ["trace_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["trace_id", "target"], "left_semi")


def on_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of all types that join neighbours on a path (trace_id, path)."""
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("source"), F.get("path", i + 1).alias("target")))
    pairs = paths.where(F.size("path") > 1).select("trace_id", F.explode(steps).alias("p")).select("trace_id", "p.*").distinct()
    return edges.join(pairs, ["trace_id", "source", "target"], "left_semi")


def packed(nodes: DataFrame, ranked: DataFrame, mandatory: DataFrame, most: int = 80, room: int = 14_000) -> DataFrame:
    """Nodes within the budgets: mandatory ones first, final actions before conclusions before errors and late ones before early, then by ``rank`` (trace_id, node_id, rank).

    Returns trace_id, node_id, size, place.
    """
    must = mandatory.select("trace_id", "node_id").distinct().withColumn("_must", F.lit(1))
    low = F.lower(F.coalesce("content", F.lit("")))
    first = F.when((F.col("type") == "Action") & F.contains(low, F.lit("final_answer")), 3).when(F.col("type") == "Conclusion", 2).when(F.col("type") == "Error", 1).otherwise(0)
    rows = nodes.select("trace_id", "node_id", "ord", F.length(F.coalesce("content", F.lit(""))).alias("size"), first.alias("_first")).join(must, ["trace_id", "node_id"], "left").join(ranked.select("trace_id", "node_id", "rank"), ["trace_id", "node_id"], "left")
    rows = rows.where("_must is not null or rank is not null")
    order = [F.desc(F.col("_must").isNotNull()), F.when(F.col("_must").isNotNull(), -F.col("_first")), F.when(F.col("_must").isNotNull(), -F.col("ord")), "rank", "ord"]
    return budgeted(rows, order, F.col("node_id"), F.col("size"), most, room).withColumnRenamed("item", "node_id")


def outcome_anchors(nodes: DataFrame, last: int = 12) -> DataFrame:
    """What the outcome of a trace is seen in: conclusions and final actions, late errors that speak of the answer, late plans, actions and facts of the same spans; else its last node."""
    low = F.lower(F.coalesce("content", F.lit("")))
    w = Window.partitionBy("trace_id")
    rows = nodes.withColumn("_late", F.max("ord").over(w) - F.col("ord") < last).withColumn("_end", F.max("ord").over(w) == F.col("ord"))
    main = (F.col("type") == "Conclusion") | ((F.col("type") == "Action") & F.contains(low, F.lit("final_answer"))) | (F.col("_late") & (F.col("type") == "Error") & low.rlike("final|answer|submit|conclusion"))
    rows = rows.withColumn("_main", main)
    spanned = rows.withColumn("_span", F.max(F.when(F.col("_main"), 1)).over(Window.partitionBy("trace_id", "span_id")))
    spanned = spanned.withColumn("_any", F.max(F.col("_main").cast("int")).over(w))
    near = F.col("_late") & F.col("type").isin("Planning", "Action", "Fact") & (F.col("_span") == 1) & F.col("span_id").isNotNull()
    return spanned.where(F.col("_main") | near | ((F.col("_any") == 0) & F.col("_end"))).select("trace_id", "node_id", "ord", "content")


def packed_slice(nodes: DataFrame, edges: DataFrame, most: int = 40, room: int = 18_000) -> DataFrame:
    """The slice that leads to the outcome, ranked by anchors, distance, saliency and place, within the budgets; anchors are always in it.

    Returns trace_id, node_id, hops, place.
    """
    seeds = outcome_anchors(nodes).select("trace_id", "node_id")
    found = backward_slice(seeds, edges).join(nodes.select("trace_id", "node_id", "ord", "saliency", F.length(F.coalesce("content", F.lit(""))).alias("size")), ["trace_id", "node_id"])
    anchor = F.col("hops") == 0
    taken = found.where(anchor).groupBy("trace_id").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    rest = found.where(~anchor).join(taken, "trace_id")
    kind = dict(found.dtypes)["node_id"]
    listed = rest.groupBy("trace_id", "_n", "_size").agg(F.array_sort(F.collect_list(F.struct("hops", (-F.col("saliency")).alias("s"), "ord", "node_id", "size"))).alias("xs"))
    start = F.struct(F.col("_n").cast("long").alias("n"), F.col("_size").cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] < most) & (acc["used"] + x["size"] <= room)
        return F.when(fits, F.struct((acc["n"] + 1).alias("n"), (acc["used"] + x["size"]).cast("long").alias("used"), F.array_append(acc["kept"], x["node_id"]).alias("kept"))).otherwise(acc)

    more = listed.select("trace_id", F.explode(F.aggregate("xs", start, step, lambda acc: acc["kept"])).alias("node_id"))
    kept = found.join(more.unionByName(found.where(anchor).select("trace_id", "node_id")), ["trace_id", "node_id"], "left_semi")
    w = Window.partitionBy("trace_id").orderBy("hops", F.desc("saliency"), "ord")
    return kept.select("trace_id", "node_id", "hops", F.row_number().over(w).alias("place"))


def subgraph_summary(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Of each trace, how much of its graph is kept: nodes, edges, their shares, and estimated tokens; and which share of outcome and of odd nodes is.

    Odd nodes are the ten of highest saliency, failures first. Needs nodes with saliency.
    """
    ids = kept.select("trace_id", "node_id").distinct().withColumn("_k", F.lit(1))
    odd = anomalies(nodes, 10).select("trace_id", "node_id").withColumn("_odd", F.lit(1))
    ends = anchors(nodes).select("trace_id", "node_id").withColumn("_end", F.lit(1))
    rows = nodes.join(ids, ["trace_id", "node_id"], "left").join(odd, ["trace_id", "node_id"], "left").join(ends, ["trace_id", "node_id"], "left")
    both = lambda c: F.count_if(F.col("_k").isNotNull() & F.col(c).isNotNull())
    n = rows.groupBy("trace_id").agg(F.count("*").alias("all_nodes"), F.count("_k").alias("node_count"), F.sum(F.when(F.col("_k") == 1, F.length("content")).otherwise(0)).alias("_chars"), both("_odd").alias("_o"), F.count("_odd").alias("_os"), both("_end").alias("_e"), F.count("_end").alias("_es"))
    e = edges.groupBy("trace_id").agg(F.count("*").alias("all_edges")).join(between(edges, ids).groupBy("trace_id").agg(F.count("*").alias("edge_count")), "trace_id", "left")
    out = n.join(e, "trace_id", "left").na.fill(0, ["all_edges", "edge_count"])
    share = lambda a, b: F.round(F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double"), 4)
    return out.select("trace_id", "node_count", "edge_count", share("node_count", "all_nodes").alias("node_ratio"), share("edge_count", "all_edges").alias("edge_ratio"), F.greatest(F.floor(F.col("_chars") / 4), F.lit(1)).cast("long").alias("estimated_tokens"), share("_e", "_es").alias("anchor_coverage"), share("_o", "_os").alias("anomaly_coverage"))
