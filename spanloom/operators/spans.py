"""Span trees: parents, ancestors, order and the fault signatures that read straight off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.lineage import checkpointed

# The fault catalogue, id to name, category and base confidence of a finding.
FAULTS = (
    ("F1", "Goal drift", "planning", 0.88), ("F2", "Plan omission", "planning", 0.0), ("F3", "Action loop", "planning", 0.78), ("F4", "Execution crash", "tool", 0.98),
    ("F5", "Unknown tool", "tool", 0.86), ("F6", "Misread result", "reasoning", 0.55), ("F7", "Unsupported claim", "reasoning", 0.0), ("F8", "Format violation", "output", 0.94),
    ("F9", "Contract violation", "tool", 0.97), ("F10", "Failed retry", "recovery", 0.84), ("F11", "Ignored error", "recovery", 0.72), ("F12", "Cascading failure", "system", 0.76),
)
FORMAT_PATTERN = r"(?i)parse error|invalid json|malformed|format error|jsondecodeerror"
UNKNOWN_TOOL_PATTERN = r"(?i)unknown tool|tool not found|no such tool|undefined function"


def in_order(spans: DataFrame) -> DataFrame:
    """Spans with ``seq``, their place by time; spans of one time stay in preorder (``pos``)."""
    return spans.withColumn("seq", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "pos")))


def with_parent(spans: DataFrame) -> DataFrame:
    """Spans with ``is_root``: no parent, an unknown one, or itself. Ids are unique within a trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_known"))
    out = spans.join(parents, ["trace_id", "parent_id"], "left")
    return out.withColumn("is_root", F.col("_known").isNull() | (F.col("parent_id") == F.col("span_id"))).drop("_known")


def inner(spans: DataFrame) -> DataFrame:
    """Spans that others name as their parent: all that lie on a way up. Most spans are leaves."""
    return spans.join(spans.where("parent_id is not null").select("trace_id", F.col("parent_id").alias("span_id")).distinct(), ["trace_id", "span_id"], "left_semi")


def jumps(spans: DataFrame) -> list[DataFrame]:
    """Pointers (trace_id, span_id, up) to the 1st, 2nd, 4th, ... ancestor, each table written once, until no span has one.

    Each doubles the one before. After as many as the spans of the largest trace allow, only spans that lead into a
    cycle still have a pointer; these are the rows of a last table, which is empty for forests.
    """
    now = checkpointed(_linked(spans).select("trace_id", "span_id", F.col("parent_id").alias("up")))
    longest = now.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    out, k = [now], 1
    while k <= longest:
        higher = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_next"))
        now = checkpointed(now.join(higher, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_next").alias("up")))
        out.append(now)
        if now.isEmpty():
            break
        k *= 2
    return out


def _linked(spans: DataFrame) -> DataFrame:
    return spans.where("parent_id is not null and parent_id != span_id")


def lines(spans: DataFrame) -> DataFrame:
    """The ancestors of each inner span that has any, nearest first (trace_id, span_id, line); a cycle ends where it closes.

    A line is joined to that of its last span, so that the rounds grow with the logarithm of the depth.
    """
    now = checkpointed(_linked(inner(spans)).select("trace_id", "span_id", F.array("parent_id").alias("line"), F.lit(True).alias("open")))
    while not now.where("open").isEmpty():
        above = now.select("trace_id", F.col("span_id").alias("_top"), F.col("line").alias("_more"), F.col("open").alias("_open"))
        rows = now.withColumn("_top", F.when(F.col("open"), F.element_at("line", -1))).join(above, ["trace_id", "_top"], "left")
        rows = rows.withColumn("_all", F.when(F.col("_more").isNotNull(), F.concat("line", "_more")).otherwise(F.col("line")))
        rows = rows.withColumn("_once", F.array_remove(F.array_distinct("_all"), F.col("span_id")))
        now = checkpointed(rows.select("trace_id", "span_id", F.col("_once").alias("line"), (F.coalesce("_open", F.lit(False)) & (F.size("_once") == F.size("_all"))).alias("open")))
    return now.select("trace_id", "span_id", "line")


def ancestors(spans: DataFrame) -> DataFrame:
    """All (trace_id, span_id, ancestor_id, dist) of the forest; a cycle ends where it closes.

    Lines are only found for inner spans; every span then has its parent and the line of that, in one join. Rows are
    as many as the depths of all spans together; ``nearest_ancestor`` and ``descendants_count`` do without them.
    """
    above = lines(spans).select("trace_id", F.col("span_id").alias("parent_id"), "line")
    rows = _linked(spans).select("trace_id", "span_id", "parent_id").join(above, ["trace_id", "parent_id"], "left")
    every = F.when(F.col("line").isNotNull(), F.concat(F.array("parent_id"), "line")).otherwise(F.array("parent_id"))
    return rows.select("trace_id", "span_id", F.posexplode(every).alias("dist", "ancestor_id")).where("span_id != ancestor_id").select("trace_id", "span_id", "ancestor_id", (F.col("dist") + 1).alias("dist"))


def nearest_ancestor(spans: DataFrame, value: Column, name: str) -> DataFrame:
    """For each span with one, the nearest ancestor where ``value`` isn't blank, as ``name``, and its distance.

    Every span looks as far up as its pointer reaches; each round doubles that for those that have found nothing.
    """
    rows = spans.select("trace_id", "span_id", F.when(F.col("parent_id") != F.col("span_id"), F.col("parent_id")).alias("up"), value.alias("_own")).distinct()
    held = rows.where(F.trim("_own") != "").select("trace_id", F.col("span_id").alias("up"), F.col("_own").alias(name))
    # what the spans' first ancestor says, and where to look next
    known = rows.where("up is not null").select("trace_id", "span_id", "up").distinct().join(held, ["trace_id", "up"], "left")
    now = checkpointed(known.select("trace_id", "span_id", "up", name, F.when(F.col(name).isNotNull(), 1).alias("dist")))
    longest, k = now.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0, 1
    while True:
        open_ = now.where(F.col(name).isNull())
        if k > longest or open_.isEmpty():
            return now.where(F.col(name).isNotNull()).groupBy("trace_id", "span_id").agg(F.min_by(name, "dist").alias(name), F.min("dist").alias("dist"))
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col(name).alias("_name"), F.col("dist").alias("_dist"))
        found = open_.join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_up").alias("up"), F.col("_name").alias(name), (F.col("_dist") + k).alias("dist"))
        now = checkpointed(now.where(F.col(name).isNotNull()).unionByName(found))
        k *= 2


def descendants_count(spans: DataFrame) -> DataFrame:
    """Number of descendants of each span that has any.

    Counts down to 2k levels are counts down to k levels plus those of the descendants k levels below; as leaves have none, only
    inner spans have pointers. Only traces with a cycle need the closure itself, as a descendant may be met twice there.
    """
    links = _linked(spans).select("trace_id", "span_id", "parent_id")
    steps = jumps(inner(links))
    bad = steps[-1].select("trace_id").distinct()
    cyclic = not steps[-1].isEmpty()
    apart = lambda rows: rows.join(bad, "trace_id", "left_anti") if cyclic else rows
    now = apart(links).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("descendants"))
    for step in steps[:-1]:
        now = checkpointed(now)
        below = apart(step).join(now, ["trace_id", "span_id"]).select("trace_id", F.col("up").alias("span_id"), "descendants")
        now = now.unionByName(below).groupBy("trace_id", "span_id").agg(F.sum("descendants").alias("descendants"))
    if not cyclic:
        return now
    return now.unionByName(ancestors(links.join(bad, "trace_id", "left_semi")).groupBy("trace_id", F.col("ancestor_id").alias("span_id")).agg(F.count("*").alias("descendants")))


def repeated_attempts(spans: DataFrame, least: int = 3) -> DataFrame:
    """Of each trace, the largest group of calls of one tool with the same input; ties go to the one seen first."""
    groups = spans.groupBy("trace_id", "tool", "input").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "Error").alias("errors"), F.min("pos").alias("first_pos")).where(F.col("attempts") >= least)
    w = Window.partitionBy("trace_id").orderBy(F.desc("attempts"), "first_pos")
    return groups.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def failed_retries(spans: DataFrame, least: int = 2) -> DataFrame:
    """Traces whose largest group of repeated attempts holds at least ``least`` errors."""
    return repeated_attempts(spans).where(F.col("errors") >= least)


def errors_before_final(spans: DataFrame, last: int = 3) -> DataFrame:
    """The last errors before a trace's last final answer."""
    final = F.max(F.when(F.col("is_final"), F.col("pos"))).over(Window.partitionBy("trace_id"))
    errors = spans.withColumn("final_pos", final).where((F.col("status") == "Error") & (F.col("pos") < F.col("final_pos")))
    w = Window.partitionBy("trace_id").orderBy(F.desc("pos"))
    return errors.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last).select("trace_id", "span_id", "pos", "final_pos", "back")


def shared_parent_errors(spans: DataFrame, least: int = 2) -> DataFrame:
    """Of each trace, the parent with most failed children, if there are at least ``least``; ties go to the first."""
    bursts = spans.where((F.col("status") == "Error") & F.col("parent_id").isNotNull()).groupBy("trace_id", "parent_id").agg(F.count("*").alias("errors"), F.min("pos").alias("first_pos")).where(F.col("errors") >= least)
    w = Window.partitionBy("trace_id").orderBy(F.desc("errors"), "first_pos")
    return bursts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def text_faults(spans: DataFrame) -> DataFrame:
    """Spans whose text shows a format violation (F8) or an unknown tool (F5)."""
    text = F.concat_ws(" ", "tool", "status", "input", "content")
    hits = F.array(F.when(text.rlike(FORMAT_PATTERN), "F8"), F.when(text.rlike(UNKNOWN_TOOL_PATTERN), "F5"))
    return spans.select("trace_id", "span_id", F.explode(F.array_compact(hits)).alias("fault_id"))


def fault_findings(spans: DataFrame) -> DataFrame:
    """One row for each fault that a trace shows: fault_id, name, category, confidence, n_evidence."""
    part = lambda df, fault, n: df.select("trace_id", F.lit(fault).alias("fault_id"), n.cast("long").alias("n_evidence"))
    one = lambda df: df.groupBy("trace_id").agg(F.count("*").alias("n"))
    found = part(repeated_attempts(spans), "F3", F.col("attempts"))
    found = found.union(part(failed_retries(spans), "F10", F.col("errors")))
    found = found.union(part(one(errors_before_final(spans)), "F11", F.col("n")))
    found = found.union(part(shared_parent_errors(spans), "F12", F.col("errors")))
    found = found.union(part(one(spans.where("status = 'Error'")), "F4", F.col("n")))
    found = found.union(text_faults(spans).groupBy("trace_id", "fault_id").agg(F.count("*").alias("n_evidence")))
    catalogue = spans.sparkSession.createDataFrame(list(FAULTS), "fault_id string, name string, category string, confidence double")
    return found.join(F.broadcast(catalogue), "fault_id").select("trace_id", "fault_id", "name", "category", "confidence", "n_evidence")  # twelve rows
