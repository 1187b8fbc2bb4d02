"""Normalising what judges and validators say: chains, semantic edges and scores, missed and extra items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import numbers
from spanloom.operators import alignment

# Edge types of the states of a delivery link.
LINK_EDGES = {"PROPAGATED": "SemanticPropagation", "TRANSFORMED": "SemanticPropagation", "REJECTED": "SemanticRejection", "EXPOSED": "EvidenceExposure"}


def upstream(root: Column, path: Column) -> Column:
    """A causal path that begins with its root cause; without a root it stays."""
    return F.when(root.isNull(), path).otherwise(F.concat(F.array(root), F.array_remove(path, root)))


def normalised_chains(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """Chains (trace_id, chain, root, path) with the root first, and whether each step is an edge of the graph."""
    rows = chains.withColumn("path", upstream(F.col("root"), F.col("path")))
    steps = rows.select("trace_id", "chain", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("source"), F.get("path", i + 1).alias("target")))).alias("s")).select("trace_id", "chain", "s.*")
    known = edges.select("trace_id", "source", "target").distinct().withColumn("ok", F.lit(1))
    valid = steps.join(known, ["trace_id", "source", "target"], "left").groupBy("trace_id", "chain").agg((F.count("*") == F.count("ok")).alias("path_valid"))
    return rows.join(valid, ["trace_id", "chain"], "left").withColumn("path_valid", F.coalesce("path_valid", F.lit(True)))


def semantic_edges(links: DataFrame) -> DataFrame:
    """Edges of delivery links: what was propagated, rejected or only shown."""
    kind = F.lit(None).cast("string")
    for k, v in LINK_EDGES.items():
        kind = F.when(F.col("state") == k, v).otherwise(kind)
    return links.select("trace_id", "source", "target", kind.alias("edge_type"), F.col("confidence").alias("score")).where("edge_type is not null")


def semantic_scores(violations: DataFrame, reach: DataFrame) -> DataFrame:
    """The highest score of a span's violations: confidence by severity, less where the evidence doesn't reach the final answer.

    ``reach``: trace_id, span_id, probability.
    """
    p = F.when(F.col("probability").isNotNull(), F.greatest(F.col("probability"), F.lit(0.65))).otherwise(0.35)
    score = F.col("confidence") * numbers.of(numbers.SEVERITY, F.col("severity"), 0.5) * p
    return violations.join(reach, ["trace_id", "span_id"], "left").groupBy("trace_id", "span_id").agg(F.round(F.max(score), 4).alias("semantic_error_score"))


def missed_and_extra(pairs: DataFrame) -> DataFrame:
    """Of each trace and impact: human findings that no automatic one meets, and automatic ones without a usable location."""
    j = alignment.judged(pairs)
    return j.groupBy("trace_id", F.col("human_impact").alias("impact")).agg(F.count_if(~F.col("exact") & ~F.col("chain_aware")).alias("missed"), F.count_if(alignment.unknown_location(F.col("auto_location"))).alias("extra"))
