"""A batch of judgements: what each trace's judge is asked, over several views of it, with failures kept to their rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import json as js
from spanloom.functions import text
from spanloom.operators import reports, validation

SOURCES = ("raw", "graph", "pure_graph")
#: What a judge is told to do, by kind of question.
TASKS = {
    "default": "Find the errors of this agent run and what caused them. Name the span or node of each.",
    "code": "Find where this run of a coding agent went wrong: wrong file, wrong edit, failed command, or a test that was not run.",
    "review": "Check the judgement below against the digest. Keep what the digest shows, and correct or drop the rest.",
    "unprocessed": "Judge this run from its raw spans alone.",
    "compare": "Match the findings of two judges. Say for each pair whether result, place and impact agree.",
    "repair": "The text below should have been one JSON object. Return that object and nothing else.",
}
SHAPE = '{"errors": [], "root_causes": [], "causal_chains": [], "coverage_checks": {}, "scores": {}}'


def prompt(kind: str, body: Column, most: int = 28_000) -> Column:
    """The question of a kind about a text, of which the middle is cut beyond ``most`` characters."""
    if kind not in TASKS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(TASKS)}")
    head = f"{TASKS[kind]}\nAnswer with one JSON object of this shape: {SHAPE}\n\n"
    return F.concat(F.lit(head), text.middle_cut(F.coalesce(body, F.lit("")), most))


def questions(views: dict[str, DataFrame], kind: str = "default", most: int = 28_000) -> DataFrame:
    """A row for each trace and view (trace_id, body): trace_id, source, prompt, tokens. Traces that lack a view have no row of it."""
    out = None
    for source, view in views.items():
        asked = prompt(kind, F.col("body"), most)
        part = view.select(F.col("trace_id").cast("string").alias("trace_id"), F.lit(source).alias("source"), asked.alias("prompt")).withColumn("tokens", text.token_estimate(F.col("prompt")).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def offline(question: str) -> str:
    """A judge without a model: its only cause is the first word of the question's last line; usage is counted in words."""
    body = question.rstrip().rsplit("\n", 1)[-1]
    words = body.split()
    answer = {"root_causes": [{"location": words[0], "reason": "named first"}] if words else [], "errors": [], "usage": {"prompt_tokens": len(question.split()), "completion_tokens": 8}}
    return json.dumps(answer)


def answered(asked: DataFrame, judge: reports.Judge = offline, tries: int = 3) -> DataFrame:
    """Answers to questions (trace_id, source, prompt): ok, error, judgement, prompt_tokens, completion_tokens and tries.

    An answer that isn't JSON is sent back to be repaired; a judge that fails is asked again; either fails its own row alone.
    """
    fix = f"{TASKS['repair']}\n\n"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for question in batch.column("prompt").to_pylist():
                found, error, n, sent = None, "no JSON in the answer", 0, question
                while found is None and n < tries:
                    n += 1
                    try:
                        said = judge(sent)
                        found = js.lenient(said)
                        sent = fix + said if found is None else sent
                    except Exception as e:
                        error = str(e)[:200]
                usage = json.loads(found).get("usage") if found else None
                usage = usage if isinstance(usage, dict) else {}
                count = lambda k: usage.get(k) if isinstance(usage.get(k), int) else None  # noqa: B023, E731
                rows.append((found is not None, None if found else error, found, count("prompt_tokens"), count("completion_tokens"), n))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            names = ("ok", "error", "judgement", "prompt_tokens", "completion_tokens", "tries")
            yield pa.RecordBatch.from_arrays([batch.column("trace_id"), batch.column("source"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["trace_id", "source", *names])

    schema = "trace_id string, source string, ok boolean, error string, judgement string, prompt_tokens long, completion_tokens long, tries int"
    return asked.select("trace_id", "source", "prompt").mapInArrow(ask, schema)


def batch(views: dict[str, DataFrame], done: DataFrame | None = None, judge: reports.Judge = offline, kind: str = "default") -> DataFrame:
    """Judgements of all views of all traces that ``done`` (trace_id, source) lacks: how a batch goes on."""
    asked = questions(views, kind)
    if done is not None:
        asked = asked.join(done.select("trace_id", "source").distinct(), ["trace_id", "source"], "left_anti")
    return answered(asked, judge)


def usage(judgements: DataFrame) -> DataFrame:
    """Tokens of each source, and what it saves against raw; sources without a count have nulls."""
    rows = judgements.groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    raw = F.max(F.when(F.col("source") == "raw", F.col("prompt_tokens"))).over(Window.partitionBy(F.lit(0)))  # a row a source
    return rows.withColumn("saving", F.round(F.try_divide((raw - F.col("prompt_tokens")).cast("double"), raw.cast("double")), 4))


def checked(judgements: DataFrame) -> DataFrame:
    """All nine checks of each judgement (trace_id, source, check, verdict); what it doesn't say is ``not_checked``."""
    told = F.from_json(F.get_json_object("judgement", "$.coverage_checks"), "map<string,string>")
    checks = F.array(*[F.lit(c) for c in validation.CHECKS])
    rows = judgements.where("ok").select("trace_id", "source", told.alias("_told"), F.explode(checks).alias("check"))
    said = F.lower(F.trim(F.element_at(F.coalesce("_told", F.create_map().cast("map<string,string>")), F.col("check"))))
    return rows.select("trace_id", "source", "check", F.when(said.isin("pass", "fail", "warning"), said).otherwise("not_checked").alias("verdict"))


def diagnosis(causes: DataFrame, chains: DataFrame, findings: DataFrame) -> DataFrame:
    """Of each trace the first that tells of its failure (trace_id, location, reason, basis): its judged root cause of least place, else its best chain, else its surest fault finding.

    ``causes``: trace_id, place, location, reason. ``chains``: trace_id, rank, node_id, cause_type. ``findings``: trace_id, fault_id, confidence.
    """
    key = lambda df: df.withColumn("trace_id", F.col("trace_id").cast("string"))
    one = key(causes).groupBy("trace_id").agg(F.min_by(F.struct(F.col("location").cast("string").alias("location"), F.col("reason").cast("string").alias("reason")), "place").alias("a"))
    two = key(chains).groupBy("trace_id").agg(F.min_by(F.struct(F.col("node_id").cast("string").alias("location"), F.col("cause_type").cast("string").alias("reason")), "rank").alias("b"))
    three = key(findings).groupBy("trace_id").agg(F.max_by(F.struct(F.lit("unknown").alias("location"), F.col("fault_id").cast("string").alias("reason")), F.struct("confidence", "fault_id")).alias("c"))
    every = one.join(two, "trace_id", "full").join(three, "trace_id", "full")
    best = F.coalesce("a", "b", "c")
    return every.select("trace_id", best["location"].alias("location"), best["reason"].alias("reason"), F.when(F.col("a").isNotNull(), "judgement").when(F.col("b").isNotNull(), "chain").otherwise("rule").alias("basis"))
