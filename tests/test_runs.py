"""Stages, the command line, the service, validation rules and judges that fail, on small hand-written inputs."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import cli, service, stages
from spanloom.functions import json as js
from spanloom.operators import digests, graph, judging, semantics, strategies, suspicion
from spanloom.streaming import monitor

OTLP = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [
    {"traceId": "t1", "spanId": "a", "name": "CodeAgent.run", "startTimeUnixNano": "1000", "endTimeUnixNano": "9000", "attributes": [{"key": "input.value", "value": {"stringValue": "find x"}}]},
    {"traceId": "t1", "spanId": "b", "parentSpanId": "a", "name": "search", "startTimeUnixNano": "2000", "endTimeUnixNano": "3000", "status": {"code": 2}, "attributes": [{"key": "tool.name", "value": {"stringValue": "search"}}, {"key": "output.value", "value": {"stringValue": "timeout"}}]},
    {"traceId": "t1", "spanId": "c", "parentSpanId": "a", "name": "final", "startTimeUnixNano": "4000", "endTimeUnixNano": "5000", "attributes": [{"key": "output.value", "value": {"stringValue": "final answer: 1"}}]},
]}]}]}


def test_stages_resume_skip_and_keep_going(spark, tmp_path):
    made = []

    def make(name, rows):
        def stage(tables):
            made.append(name)
            if rows is None:
                raise ValueError("broken")
            return spark.createDataFrame([(r,) for r in rows], "trace_id long")

        return stage

    plan = {"a": (make("a", [1, 2]), ()), "b": (make("b", None), ("a",)), "c": (make("c", [1]), ("b",)), "d": (make("d", [3]), ("a",))}
    first = stages.run(spark, plan, str(tmp_path), keep_going=True)
    assert first.status == {"a": "made", "b": "failed: broken", "c": "skipped", "d": "made"} and made == ["a", "b", "d"]
    assert {r.stage: r.rows for r in stages.report(spark, first).collect()} == {"a": 2, "b": None, "c": None, "d": 1}
    again = stages.run(spark, plan, str(tmp_path))
    assert again.status == {"a": "there already", "b": "failed: broken"}
    more = {"a": (make("a", [2, 3]), ())}
    stages.run(spark, more, str(tmp_path), key="trace_id")
    assert sorted(r.trace_id for r in spark.read.parquet(f"{tmp_path}/a").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="unknown stages: x"):
        stages.wanted(["a"], "a,x")


@pytest.mark.parametrize("command", ["validate", "prune", "paths", "summary", "diagnose"])
def test_command_line(spark, tmp_path, command):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.json").write_text(json.dumps(OTLP))
    cli.main([command, str(tmp_path / "in/*.json"), str(tmp_path / "out"), "--strategy", "bm25_retrieval"])
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert rows and all(r.trace_id == "t1" for r in rows) if command != "paths" else rows is not None
    if command == "validate":
        assert [r.verdict for r in rows] == ["invalid"]


def test_service(spark):
    s = service.Service(spark)
    assert s.answer("GET", "/api/health") == (200, {"ok": True, "events": 0})
    assert s.answer("GET", "/nowhere")[0] == 404 and s.answer("POST", "/api/parse", b"{")[0] == 400
    status, out = s.answer("POST", "/api/upload", json.dumps([{"path": "a", "value": json.dumps(OTLP)}, {"path": "b", "value": "{"}]).encode())
    assert status == 200 and len(out["graphs"]) == 1 and out["errors"] == [{"path": "b", "error": "no JSON"}]
    events = [{"ts": "2024-01-01T00:00:00Z", "system_id": "s", "layer": "hardware", "measurement": 1.0}, {"system_id": "", "layer": "hardware"}, 7]
    status, out = s.answer("POST", "/api/events", json.dumps(events).encode())
    assert out["accepted"] == 1 and [r["index"] for r in out["rejected"]] == [1, 2]
    assert s.answer("POST", "/api/events", json.dumps([{}] * 1001).encode())[0] == 413
    assert len(s.answer("GET", "/api/events?layer=hardware&limit=5")[1]) == 1 and len(s.answer("GET", "/api/snapshot")[1]) == 4
    assert any(r["fault_id"] == "F4" for r in s.answer("POST", "/api/faults", json.dumps(OTLP).encode())[1])


def test_judge_repairs_retries_and_fails_alone(spark):
    views = {"raw": spark.createDataFrame([("a", "fine"), ("b", "garbled"), ("c", "down"), ("d", "never")], "trace_id string, body string")}

    def judge(question):
        if question.startswith("The text below"):
            return '{"root_causes": [], "usage": {"prompt_tokens": 3, "completion_tokens": "x"}}'
        if question.endswith("down"):
            raise OSError("429")
        return "```json\n{\"errors\": [1],}\n```" if question.endswith("fine") else "so {sorry" if question.endswith("garbled") else ""

    got = {r.trace_id: r for r in judging.batch(views, judge=judge).collect()}
    assert got["a"].ok and got["a"].tries == 1 and json.loads(got["a"].judgement) == {"errors": [1]}
    assert got["b"].ok and got["b"].tries == 2 and got["b"].prompt_tokens == 3 and got["b"].completion_tokens is None
    assert not got["c"].ok and got["c"].error == "429" and got["c"].tries == 3
    assert got["d"].ok and got["d"].tries == 2
    left = judging.batch(views, done=spark.createDataFrame([("a", "raw")], "trace_id string, source string"), judge=judge)
    assert sorted(r.trace_id for r in left.collect()) == ["b", "c", "d"]
    with pytest.raises(ValueError, match="unknown kind"):
        judging.prompt("poem", F.lit("x"))


def test_own_rules_join_the_violations(spark):
    a = lambda **kv: {k.replace("_", "."): v for k, v in kv.items()}
    rows = [(1, "r", None, "0", 0, "CodeAgent.run", "Ok", {"input.value": "do it"}), (1, "t", "r", "1", 1, "tool", "Ok", a(tool_name="calc", input_value="{}", output_value="42"))]
    s = semantics.steps(spark.createDataFrame(rows, "trace_id long, span_id string, parent_id string, ts string, pos int, name string, status string, attributes map<string,string>"))
    rule = lambda calls: calls.where("tool = 'calc'").select("trace_id", "span_id", F.lit("own").alias("violation_type"), F.lit("custom").alias("dimension"), F.lit("LOW").alias("severity"), F.lit(0.5).alias("confidence"))
    out = semantics.validate(s, (rule,))
    assert [(r.violation_type, r.state) for r in out["violations"].collect()] == [("own", "NOT_EXPOSED")]
    assert [r.verdict for r in out["checks"].collect()] == ["invalid"]


def test_propagation_walks_breadth_first():
    link = lambda t, state, c: {"consumer": t, "state": state, "confidence": c}
    links = {"a": [link("b", "PROPAGATED", 0.9), link("c", "TRANSFORMED", 0.8)], "b": [link("d", "PROPAGATED", 0.7)], "c": [link("z", "PROPAGATED", 0.6)], "d": [link("z", "PROPAGATED", 1.0)], "e": [link("z", "REJECTED", 0.9)], "f": [link("x", "EXPOSED", 0.9), link("y", "PROPAGATED", 0.5)]}
    assert semantics.report("a", links, {"z"}) == ("PROPAGATED", True, ["a", "c", "z"], 0.6)
    assert semantics.report("z", links, {"z"}) == ("PROPAGATED", True, ["z"], 1.0)
    assert semantics.report("e", links, {"z"}) == ("REJECTED", False, [], 0.9)
    assert semantics.report("f", links, {"z"}) == ("EXPOSED", False, [], 0.9)
    assert semantics.report("q", links, {"z"}) == ("NOT_EXPOSED", False, [], 1.0)


def test_anchor_rules(spark):
    node = "array<struct<node:string,location:string,type:string,role:string>>"
    on = [("A_1", "s1", "Action", "origin"), ("F_1", "s2", "Fact", "path"), ("P_1", "s3", "Planning", "usage"), ("E_1", "s4", "Error", "path"), ("C_1", "s5", "Conclusion", "final")]
    cases = {("other", "bad path"): ("s1", "upstream_root_action"), ("final_answer_symptom", ""): ("s5", "final_symptom"), ("tool_or_execution_failure", ""): ("s4", "first_visible_error"), ("format_or_tool_argument_error", "schema"): ("s4", "first_visible_error"),
             ("format_or_tool_argument_error", ""): ("s1", "bad_action_call"), ("wrong_action_or_tool_choice", ""): ("s1", "bad_action_call"), ("other", "loop"): ("s1", "bad_action_call"), ("crucial_fact_ignored", ""): ("s3", "unsupported_usage"), ("agent_trace_failure", ""): ("s3", "earliest_origin"), ("other", ""): ("s1", "earliest_origin")}
    df = spark.createDataFrame([(on, c, t) for c, t in cases], f"on {node}, cause string, said string")
    got = df.select("cause", "said", digests.anchor(F.col("on"), F.col("cause"), F.col("said")).alias("a")).collect()
    assert {(r.cause, r.said): (r.a.location, r.a.rule) for r in got} == cases


def test_first_object_in_a_text():
    assert js.balanced('say {not json} then {"a": {"b": "}"}} and {"c": 1}') == '{"a": {"b": "}"}}'
    assert js.balanced("none {") is None


def test_all_strategies_keep_to_their_budgets(spark):
    rows = [(1, k, k + 1, ("Planning", "Action", "Fact", "Error", "Conclusion")[k % 5], f"Tool: t{k % 3} | text {k} failed" + " pad" * k) for k in range(30)]
    nodes = graph.saliency(spark.createDataFrame(rows, "trace_id long, node_id long, ord int, type string, content string").withColumn("span_id", F.col("node_id")).withColumn("parent_id", F.lit(None).cast("long")).withColumn("tool", F.lit("t")))
    edges = graph.unique_edges(graph.temporal_edges(nodes).unionByName(graph.retry_edges(nodes)))
    size = {r.node_id: len(r.content) for r in nodes.collect()}
    for name in strategies.NAMES:
        kept = [r.node_id for r in strategies.pruned(nodes, edges, name, most=8, room=400).collect()]
        assert kept and len(kept) == len(set(kept))
        if name != "agenttrace_suspicious_paths":
            assert len(kept) <= 8 and sum(size[k] for k in kept) <= 400, name
    assert suspicion.described(nodes, edges).count() == 30


def test_events_are_posted_in_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"seq": i, "ts": "2024-01-01T00:00:00Z", "system_id": "s" if i else "", "layer": "hardware", "measurement": 1.0, "uid": "u"}) for i in range(25)))
    target = str(tmp_path / "posted")

    def post(rows):
        import uuid
        from pathlib import Path

        Path(target).mkdir(exist_ok=True)
        (Path(target) / uuid.uuid4().hex).write_text(str(len(rows)))

    monitor.post_events(monitor.read_events(spark, str(tmp_path / "in")), post, str(tmp_path / "c"), most=10).awaitTermination()
    parts = [int(f.read_text()) for f in (tmp_path / "posted").iterdir()]
    assert sum(parts) == 24 and max(parts) <= 10
