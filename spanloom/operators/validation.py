"""Tool-call validation and the way of evidence to the final answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text

ERROR_PATTERN = r"error|failed|failure|exception|timeout|timed out|traceback"


def result_status(status: Column, output: Column) -> Column:
    """transport_success, business_success and is_error of a tool result. Benign ``error: none`` is no failure."""
    bare = F.regexp_replace(F.lower(F.coalesce(output, F.lit(""))), r"error\"?\s*:\s*(?:none|null|false|''|\"\")", "")
    transport = ~F.lower(F.coalesce(status, F.lit(""))).isin("error", "status_code_error")
    business = ~bare.rlike(ERROR_PATTERN)
    return F.struct(transport.alias("transport_success"), business.alias("business_success"), (~transport | ~business).alias("is_error"))


# Openings that tell of a failed tool, and words that do so only where the span has no status of its own.
STRONG_ERROR = r"(?i)(?:^|\n)\s*(?:file system operation execution error\b|error when executing tool\b|tool execution (?:error|failed)\b|execution failed(?:\s+at|\s*:)|\[error\])"
WEAK_ERROR = r"(?i)(?:\btraceback\b|\bexception\b|\bsuccess\s*[:=]\s*false\b|\bfailed\b|\btimeout\b)"


def tool_status(status: Column, result: Column) -> Column:
    """transport_success, business_success (null where the result doesn't say) and is_error of a tool result.

    A result that is a JSON object speaks by its ``success`` and ``error``; other text by its opening. Words of failure within
    it count only where the status is unset, since a good call may return a document about a failure.
    """
    state, t = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.coalesce(result, F.lit(""))
    transport = ~state.isin("error", "status_code_error")
    parsed = F.json_object_keys(t).isNotNull()
    success, error = F.get_json_object(t, "$.success"), F.get_json_object(t, "$.error")
    business = F.when(parsed & success.isin("true", "false"), success == "true")
    bad = error.isNotNull() & ~error.isin("", "null", "false", "[]", "{}")
    worded = ~parsed & (t.rlike(STRONG_ERROR) | (state.isin("", "unset", "status_code_unset", "status_code_unspecified") & t.rlike(WEAK_ERROR)))
    return F.struct(transport.alias("transport_success"), business.alias("business_success"), (~transport | F.coalesce(~business, F.lit(False)) | (parsed & bad) | worded).alias("is_error"))


def fields_differ(arguments: Column, result: Column, key: Column) -> Column:
    """Whether both JSON objects have the key, with values that differ in more than case and outer white space."""
    a, b = (F.element_at(F.from_json(x, "map<string,string>"), key) for x in (arguments, result))
    return a.isNotNull() & b.isNotNull() & (F.lower(F.trim(a)) != F.lower(F.trim(b)))


def violations(calls: DataFrame) -> DataFrame:
    """Rule violations of tool calls (trace_id, span_id, status, input, output): a row each, with severity and confidence.

    Failed execution, empty result, HTTP failure, and required arguments (``required`` array, if there) that the
    JSON input lacks.
    """
    s = result_status(F.col("status"), F.col("output"))
    empty = text.strip(F.coalesce(F.col("output"), F.lit(""))).isin("", "[]", "{}", "<null>", "null")
    http = F.regexp_extract(F.coalesce(F.col("output"), F.lit("")), r"(?im)^Status: (\d{3})", 1).try_cast("int")
    keys = F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>"))
    required = F.col("required") if "required" in calls.columns else F.array().cast("array<string>")
    absent = F.array_except(required, keys)
    rule = lambda when, name, severity, confidence: F.when(when, F.struct(F.lit(name).alias("violation_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    found = F.array_compact(F.array(
        rule(F.size(absent) > 0, "missing_required_argument", "HIGH", 1.0),
        rule(s["is_error"], "tool_execution_failure", "HIGH", 1.0),
        rule(~s["is_error"] & empty, "empty_tool_result", "MEDIUM", 1.0),
        rule(http >= 400, "http_failure", "HIGH", 1.0),
    ))
    return calls.select("trace_id", "span_id", F.explode(found).alias("v")).select("trace_id", "span_id", "v.*")


def repeats_of(spans: DataFrame) -> DataFrame:
    """For each span, the latest earlier one of its trace with the same input; as-of by place. ``semantics.origins`` finds what an argument came from."""
    w = Window.partitionBy("trace_id", "input").orderBy("pos")
    return spans.select("trace_id", "span_id", F.lag("span_id").over(w).alias("origin_id")).where("origin_id is not null")


def prior_evidence(turns: DataFrame, room: int = 30_000) -> DataFrame:
    """For each turn, the length of the text of all earlier turns of others, at most ``room``, and how many there are."""
    w = Window.partitionBy("trace_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    size, n = F.sum(F.length("content")).over(w), F.count("*").over(w)
    return turns.select("trace_id", "step", F.least(F.coalesce(size + n - 1, F.lit(0)), F.lit(room)).cast("long").alias("evidence_chars"), n.alias("evidence_turns"))


def delivery_links(turns: DataFrame, least: int = 3) -> DataFrame:
    """Between each turn and the next turn of another role: shared words, state and confidence.

    PROPAGATED with ``least`` shared words or more, TRANSFORMED with one, else EXPOSED.
    """
    w = Window.partitionBy("trace_id").orderBy("step")
    words = F.array_distinct(text.tokens(F.col("content")))
    rows = turns.select("trace_id", "step", "role", words.alias("words")).withColumn("to_step", F.lead("step").over(w)).withColumn("to_role", F.lead("role").over(w)).withColumn("to_words", F.lead("words").over(w))
    rows = rows.where("to_step is not null and to_role != role").withColumn("overlap", F.size(F.array_intersect("words", "to_words")))
    state = F.when(F.col("overlap") >= least, "PROPAGATED").when(F.col("overlap") >= 1, "TRANSFORMED").otherwise("EXPOSED")
    return rows.select("trace_id", F.col("step").alias("source"), F.col("to_step").alias("target"), "overlap", state.alias("state"), F.round(F.least(0.45 + 0.1 * F.col("overlap"), F.lit(1.0)), 2).alias("confidence"))


def propagation(links: DataFrame, finals: DataFrame) -> DataFrame:
    """For each source, whether its evidence reaches the trace's final step over propagated or transformed links, and of the way found first, breadth first, the least confidence and the hops."""
    from spanloom.operators import semantics

    named = links.withColumnRenamed("target", "consumer")
    found = semantics.propagation(named, finals.withColumnRenamed("final_step", "final_id"), links.select("trace_id", "source").distinct())
    reaches = F.col("reaches_final")
    return found.select("trace_id", "source", reaches, F.when(reaches, F.col("confidence")).alias("confidence"), F.when(reaches, F.size("path") - 1).alias("hops"))


def final_steps(turns: DataFrame) -> DataFrame:
    """The last assistant turn of each trace."""
    return turns.where("role = 'assistant'").groupBy("trace_id").agg(F.max("step").alias("final_step"))


# The checks that every judgement answers.
CHECKS = ("task_understanding", "planning", "tool_selection", "tool_arguments", "tool_results", "evidence_use", "error_recovery", "format", "final_answer")


def filled_checks(judgements: DataFrame) -> DataFrame:
    """All nine checks of each trace; those that a judgement (trace_id, check, verdict) lacks are ``not_checked``."""
    every = judgements.select("trace_id").distinct().select("trace_id", F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    return every.join(judgements, ["trace_id", "check"], "left").select("trace_id", "check", F.coalesce("verdict", F.lit("not_checked")).alias("verdict"))


def role_counts(turns: DataFrame) -> DataFrame:
    """Messages and characters of each role, by conversation, with the first user text and the last assistant text."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("step")))
    last = F.max_by("content", F.when(F.col("role") == "assistant", F.col("step")))
    count = lambda r: F.count_if(F.col("role") == r)
    return turns.groupBy("trace_id").agg(F.count("*").alias("messages"), count("user").alias("n_user"), count("assistant").alias("n_assistant"), count("system").alias("n_system"), F.sum(F.length("content")).alias("chars"), F.md5(F.coalesce(first, F.lit(""))).alias("input_md5"), F.md5(F.coalesce(last, F.lit(""))).alias("output_md5"))


def date_mismatches(calls: DataFrame) -> DataFrame:
    """Calls whose result speaks of other dates than the one that was asked for (trace_id, span_id, asked)."""
    asked, told = text.dates(F.col("input")), text.dates(F.col("output"))
    return calls.where((F.size(asked) > 0) & (F.size(told) > 0) & ~F.arrays_overlap(asked, told)).select("trace_id", "span_id", F.get(asked, F.lit(0)).alias("asked"))


def argument_mismatches(calls: DataFrame, keys: tuple[str, ...] = ("date", "city", "name", "id", "url", "query")) -> DataFrame:
    """Comparable fields that differ, but for case, between a call's JSON input and its JSON result."""
    a, b = F.try_parse_json("input"), F.try_parse_json("output")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.try_variant_get(a, f"$.{k}", "string").alias("expected"), F.try_variant_get(b, f"$.{k}", "string").alias("observed")) for k in keys])
    rows = calls.select("trace_id", "span_id", F.explode(pairs).alias("p")).select("trace_id", "span_id", "p.*")
    return rows.where("expected is not null and observed is not null and lower(expected) != lower(observed)")


def ungrounded_arguments(calls: DataFrame, room: int = 30_000) -> DataFrame:
    """Id-like argument values that neither the task (``task``) nor an earlier result of the trace holds."""
    w = Window.partitionBy("trace_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.right(F.concat_ws("\n", F.collect_list("output").over(w)), F.lit(room))
    rows = calls.withColumn("_seen", F.concat_ws("\n", "task", seen)).select("trace_id", "span_id", "_seen", F.explode(text.opaque_tokens(F.col("input"))).alias("token"))
    return rows.where(F.instr(F.col("_seen"), F.col("token")) == 0).select("trace_id", "span_id", "token")


def verdicts(calls: DataFrame, found: DataFrame) -> DataFrame:
    """valid, invalid or uncertain for each call: uncertain if all it is charged with are ungrounded arguments."""
    marks = found.groupBy("trace_id", "span_id").agg(F.bool_or(F.col("violation_type") != "ungrounded_tool_argument").alias("hard"))
    out = calls.select("trace_id", "span_id").join(marks, ["trace_id", "span_id"], "left")
    return out.select("trace_id", "span_id", F.when(F.col("hard").isNull(), "valid").when(F.col("hard"), "invalid").otherwise("uncertain").alias("verdict"))
