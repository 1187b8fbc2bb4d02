"""Scoring automatic findings against human ones: locations, coverage by policy, audits and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text

IMPACTS = ("LOW", "MEDIUM", "HIGH")


def unknown_location(x: Column) -> Column:
    """Whether a location says nothing."""
    return x.isNull() | F.lower(F.trim(x)).isin("", "unknown", "none", "null", "n/a")


def location_match(a: Column, b: Column) -> Column:
    """Whether locations share an id, or, without ids, are equal but for case. Unknown ones never match."""
    ia, ib = text.ids_in(a), text.ids_in(b)
    any_id = (F.size(ia) > 0) | (F.size(ib) > 0)
    return F.when(unknown_location(a) | unknown_location(b), False).when(any_id, F.arrays_overlap(ia, ib)).otherwise(F.lower(a) == F.lower(b))


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs with the match of each policy: semantic (impact), exact location, chain-aware (adjacent id), strict (both)."""
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"_([0-9]+)", 1).try_cast("long")
    exact = location_match(F.col("human_location"), F.col("auto_location"))
    chain = exact | (~unknown_location(F.col("auto_location")) & (F.abs(number(F.col("human_location")) - number(F.col("auto_location"))) <= 1))
    impact = F.col("human_impact") == F.col("auto_impact")
    return pairs.select("*", impact.alias("semantic"), exact.alias("exact"), F.coalesce(chain, F.lit(False)).alias("chain_aware"), (impact & exact).alias("strict"))


def coverage(pairs: DataFrame) -> DataFrame:
    """Matched share by policy and impact, and over all impacts (impact 'ALL')."""
    rows = judged(pairs).select("human_impact", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("hit")) for p in ("semantic", "exact", "chain_aware", "strict")])).alias("x")).select("human_impact", "x.*")
    out = rows.groupingSets([["policy", "human_impact"], ["policy"]], "policy", "human_impact").agg(F.count("*").alias("human_total"), F.count_if("hit").alias("matched"), F.grouping("human_impact").alias("g"))
    return out.select("policy", F.when(F.col("g") == 1, "ALL").otherwise(F.col("human_impact")).alias("impact"), "human_total", "matched", F.round(F.col("matched").cast("double") / F.col("human_total").cast("double"), 4).alias("coverage"))


def macro_and_pooled(pairs: DataFrame) -> DataFrame:
    """Per trace: the mean of the three impacts' coverages (an empty one counts 1) and the pooled coverage (empty: 0)."""
    j = judged(pairs)
    parts = [F.coalesce(F.try_divide(F.count_if(F.col("strict") & (F.col("human_impact") == i)).cast("double"), F.count_if(F.col("human_impact") == i).cast("double")), F.lit(1.0)) for i in IMPACTS]
    pooled = F.coalesce(F.try_divide(F.count_if("strict").cast("double"), F.count("*").cast("double")), F.lit(0.0))
    return j.groupBy("trace_id").agg(F.round((parts[0] + parts[1] + parts[2]) / 3, 4).alias("macro"), F.round(pooled, 4).alias("pooled"))


RELATIONS = ("exact", "adjacent", "unknown", "different")


def location_audit(pairs: DataFrame) -> DataFrame:
    """Per trace, how automatic locations relate to the human ones; all relations are kept, with zeros."""
    relation = F.when(F.col("exact"), "exact").when(F.col("chain_aware"), "adjacent").when(unknown_location(F.col("auto_location")), "unknown").otherwise("different")
    rows = judged(pairs).select("trace_id", relation.alias("relation"))
    counts = rows.groupBy("trace_id").agg(F.count("*").alias("pairs"), *[F.count_if(F.col("relation") == r).alias(r) for r in RELATIONS])
    return counts.withColumn("exact_rate", F.round(F.col("exact").cast("double") / F.col("pairs").cast("double"), 4))


def token_savings(usage: DataFrame) -> DataFrame:
    """Per group: raw and graph tokens and the share saved; null without raw tokens."""
    out = usage.groupBy("group").agg(F.sum(F.coalesce(F.col("raw").cast("decimal(18,2)"), F.lit(0))).alias("r"), F.sum(F.coalesce(F.col("graph").cast("decimal(18,2)"), F.lit(0))).alias("g"))
    r, g = F.col("r").cast("double"), F.col("g").cast("double")
    return out.select("group", F.round(r, 2).alias("raw"), F.round(g, 2).alias("graph"), F.round(F.try_divide(r - g, r), 4).alias("saving"))


def better_of(raw: DataFrame, graph: DataFrame) -> DataFrame:
    """Of two coverages a trace, the better one: raw wins ties, graph where a side is missing."""
    both = raw.select("trace_id", F.col("coverage").alias("raw")).join(graph.select("trace_id", F.col("coverage").alias("graph")), "trace_id", "full")
    use_raw = F.col("raw").isNotNull() & F.col("graph").isNotNull() & (F.col("raw") >= F.col("graph"))
    return both.select("trace_id", F.when(use_raw, "raw").otherwise("graph").alias("source"), F.when(use_raw, F.col("raw")).otherwise(F.coalesce("graph", "raw")).alias("coverage"))
