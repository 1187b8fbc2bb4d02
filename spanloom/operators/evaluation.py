"""Evaluating judgements of many traces against annotations: matching, coverage by source and policy, averages, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers
from spanloom.operators import alignment

POLICIES = ("semantic", "exact", "chain_aware", "strict")


def impact_of(value: Column) -> Column:
    """LOW, MEDIUM or HIGH in any case, with white space around; MEDIUM for all else."""
    up = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(up.isin(*alignment.IMPACTS), up).otherwise("MEDIUM")


def normalised_items(items: DataFrame) -> DataFrame:
    """Findings (trace_id, location, impact, reason) with a location (``unknown`` if blank), a known impact and a reason of at most 400 characters."""
    place = F.trim(F.coalesce("location", F.lit("")))
    return items.select("trace_id", F.when(place == "", "unknown").otherwise(place).alias("location"), impact_of(F.col("impact")).alias("impact"), F.left(F.trim(F.coalesce("reason", F.lit(""))), F.lit(400)).alias("reason"))


def normalised_pairs(pairs: DataFrame) -> DataFrame:
    """Matched pairs with the flags of all policies: the exact location is always compared anew, a chain-aware match is taken from the judge (``chain_aware_location_match``) or follows from it."""
    exact = alignment.location_match(F.col("human_location"), F.col("auto_location"))
    told = numbers.lenient_bool(F.col("chain_aware_location_match").cast("string")) if "chain_aware_location_match" in pairs.columns else F.lit(False)
    result = numbers.lenient_bool(F.col("result_match").cast("string")) if "result_match" in pairs.columns else F.lit(True)
    chain = exact | F.coalesce(told, F.lit(False))
    good = F.coalesce(result, F.lit(False))
    return pairs.withColumn("human_impact", impact_of(F.col("human_impact"))).withColumn("semantic", good).withColumn("exact", good & exact).withColumn("chain_aware", good & chain).withColumn("strict", good & exact & (impact_of(F.col("human_impact")) == impact_of(F.col("auto_impact"))))


def coverage_block(matched: Column, total: Column, empty: float) -> Column:
    """Matches of a total, at most all of it, with coverage of four digits and in per cent; ``empty`` where there is nothing to match."""
    m = F.least(F.greatest(matched, F.lit(0)), total)
    share = F.when(total > 0, F.round(m.cast("double") / total.cast("double"), 4)).otherwise(F.lit(empty))
    return F.struct(total.alias("human_total"), m.alias("matched"), share.alias("coverage"), F.round(share * 100, 2).alias("coverage_percent"))


def trace_coverage(pairs: DataFrame, totals: DataFrame, sources: tuple[str, ...] = ("raw", "graph")) -> DataFrame:
    """Of each trace and source: root causes met (round one) and errors met of each impact (round two), by policy.

    ``pairs``: normalised, with source. ``totals``: trace_id, impact, human_total. Nothing to match counts 0 in round one and 1 in round two;
    ``macro`` is the mean of the three impacts.
    """
    each = pairs.select("trace_id", "source", F.col("human_impact").alias("impact"), F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("hit")) for p in POLICIES])).alias("x")).select("trace_id", "source", "impact", "x.*")
    hits = each.groupBy("trace_id", "source", "policy", "impact").agg(F.count_if("hit").alias("matched"))
    each_of = lambda values, name: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    every = totals.select("trace_id").distinct().select("trace_id", each_of(sources, "source")).select("*", each_of(POLICIES, "policy")).select("*", each_of(alignment.IMPACTS, "impact"))
    rows = every.join(totals, ["trace_id", "impact"], "left").join(hits, ["trace_id", "source", "policy", "impact"], "left").na.fill(0, ["human_total", "matched"])
    out = rows.groupBy("trace_id", "source", "policy").agg(F.sum("human_total").alias("_t"), F.sum(F.least("matched", "human_total")).alias("_m"), F.avg(coverage_block(F.col("matched"), F.col("human_total"), 1.0)["coverage"]).alias("macro"))
    return out.select("trace_id", "source", "policy", coverage_block(F.col("_m"), F.col("_t"), 0.0).alias("b"), F.round("macro", 4).alias("macro")).select("trace_id", "source", "policy", "b.*", "macro")


def global_rates(covered: DataFrame) -> DataFrame:
    """Of each source and policy over all traces: matches of all human findings, pooled (six digits) and as a mean of the traces (four)."""
    out = covered.groupBy("source", "policy").agg(F.count("*").alias("traces"), F.sum("human_total").alias("human_total"), F.sum("matched").alias("matched"), F.round(F.avg("coverage"), 4).alias("mean_coverage"), F.round(F.avg("macro"), 4).alias("mean_macro"))
    return out.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("human_total").cast("double")), F.lit(0.0)), 6))


def evaluated(judgements: DataFrame, annotations: DataFrame) -> DataFrame:
    """Judgements (trace_id, source, ok) with whether they can be scored: failed ones and those of traces without an annotation can't.

    A row a judgement, and one for each annotated trace that none was made for.
    """
    noted = annotations.select("trace_id").distinct().withColumn("_noted", F.lit(True))
    both = judgements.join(noted, "trace_id", "full")
    status = F.when(F.col("source").isNull(), "not judged").when(F.col("_noted").isNull(), "no annotation").when(~F.col("ok"), "judge failed").otherwise("scored")
    return both.select("trace_id", "source", status.alias("status"))


def matching_errors(causes: DataFrame, errors: DataFrame) -> DataFrame:
    """Root causes (trace_id, item, location, module) each with the first error (trace_id, place, location, module, category) of its location, else of its module."""
    e = errors.select("trace_id", "place", F.col("category").alias("category"), F.trim("location").alias("_at"), F.lower(F.trim("module")).alias("_in"))
    rows = causes.withColumn("_l", F.trim(F.coalesce("location", F.lit("")))).withColumn("_m", F.lower(F.trim(F.coalesce("module", F.lit("")))))
    found = lambda on, when, name: rows.where(when).select("trace_id", "item", F.col(on[0]).alias(on[1])).join(e, ["trace_id", on[1]]).groupBy("trace_id", "item").agg(F.min_by(F.struct("place", "category"), "place").alias(name))
    here = found(("_l", "_at"), (F.col("_l") != "") & (F.col("_l") != "unknown"), "_here")
    near = found(("_m", "_in"), F.col("_m") != "", "_near")
    out = rows.join(here, ["trace_id", "item"], "left").join(near, ["trace_id", "item"], "left")
    hit = F.coalesce("_here", "_near")
    return out.select(*causes.columns, hit["place"].alias("error_place"), hit["category"].alias("category"), F.when(F.col("_here").isNotNull(), "location").when(F.col("_near").isNotNull(), "module").alias("matched_by"))


def audit_rows(pairs: DataFrame) -> DataFrame:
    """Pairs whose locations differ, as what to look at by hand: trace_id, item, both locations, and how they relate."""
    j = alignment.judged(pairs)
    relation = F.when(F.col("exact"), "exact").when(F.col("chain_aware"), "adjacent").when(alignment.unknown_location(F.col("auto_location")), "unknown").otherwise("different")
    return j.withColumn("relation", relation).where("relation != 'exact'").select("trace_id", "item", "human_location", "auto_location", "relation")


def write_audit(pairs: DataFrame, path: str) -> None:
    """The audit as JSON lines, a folder a relation."""
    audit_rows(pairs).write.mode("overwrite").partitionBy("relation").json(path)


def input_limit(asked: Column, shell: Column, context: int = 131_072, answer: int = 2_200, safety: int = 4_096) -> Column:
    """Tokens of input that a model has room for besides the prompt's shell, at least 512, and no more than asked for (0: no wish)."""
    room = F.greatest(F.lit(512), F.lit(context - answer - safety) - shell)
    return F.when(asked > 0, F.least(asked, room)).otherwise(room)


def retry_limits(first: Column, tokens: Column, tries: int, floor: int = 8_000) -> Column:
    """Ever smaller limits for repeated tries: halved each time, down to the floor; only one if there is nothing to cut."""
    start = F.greatest(F.lit(512), F.least(first, tokens))
    low = F.least(tokens, F.lit(floor))
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(1, tries) - 1)), lambda i: F.greatest(low, F.floor(start / F.pow(F.lit(2.0), i)).cast("long")))
    steps = F.array_distinct(F.concat(F.array(start.cast("long")), F.filter(F.slice(steps, 2, max(1, tries)), lambda x: x < start)))
    return F.when(tokens <= 0, F.array(F.lit(0).cast("long"))).otherwise(steps)


def first_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
