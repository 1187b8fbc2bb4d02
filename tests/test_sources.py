"""Readers of all dialects and metrics on hand-written inputs."""

import json

from pyspark.sql import functions as F

from spanloom.functions import json as js
from spanloom.functions import numbers
from spanloom.sources import metrics, traces

OTLP = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "agent"}}]},
            "scopeSpans": [
                {
                    "spans": [
                        {"traceId": "t", "spanId": "a", "parentSpanId": "", "name": "root", "kind": 2, "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001500000000", "status": {"code": 1}, "attributes": []},
                        {"traceId": "t", "spanId": "b", "parentSpanId": "a", "name": "search", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": 1700000000000000000, "attributes": [{"key": "tool.name", "value": {"stringValue": "x"}}, {"key": "tool.name", "value": {"stringValue": "search"}}, {"key": "n", "value": {"intValue": 3}}, {"key": "output.value", "value": {"stringValue": "Timeout reached"}}]},
                    ]
                }
            ],
        }
    ]
}


def files(spark, *values):
    return spark.createDataFrame([(f"f{i}", v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "path string, value string")


def test_otlp_in_both_key_styles(spark):
    snake = json.dumps(OTLP).replace("resourceSpans", "resource_spans").replace("scopeSpans", "scope_spans").replace("traceId", "trace_id").replace("spanId", "span_id").replace("parentSpanId", "parent_span_id").replace("startTimeUnixNano", "start_time_unix_nano").replace("endTimeUnixNano", "end_time_unix_nano").replace("stringValue", "string_value").replace("intValue", "int_value")
    for value in (OTLP, snake):
        a, b = traces.otlp_spans(files(spark, value, "junk", None)).orderBy("span_id").collect()
        assert (a.parent_span_id, a.span_kind, a.duration, a.status_code, a.service_name) == (None, "Server", "PT1.500000S", "Ok", "agent")
        assert a.timestamp == "2023-11-14T22:13:20.000000Z"
        assert (b.span_kind, b.duration, b.status_code) == ("SPAN_KIND_CLIENT", "", "Error")
        assert b.attributes["tool.name"] == "search" and b.attributes["n"] == "3"


def test_dialogue_and_events_and_trees(spark):
    talk = {"question_ID": "q", "question": "why?", "history": [{"role": "user", "content": "hi"}, {"role": "assistant", "name": "Orchestrator (thought)", "content": "TERMINATE"}, {"role": "assistant", "name": "Orchestrator (-> Web)", "text": "go"}]}
    log = {"meta": {"trace_id": "e"}, "events": [{"label": "x", "at_ms": 5, "payload": {"event_type": "tool.use", "name": "grep", "args": "{}"}}, {"label": "y", "payload": {"event_type": "other"}}, {"label": "z", "at_ms": 9, "payload": {"event_type": "chat.error", "message": "boom"}}]}
    tree = {"trace_id": "g", "spans": [{"span_id": "1", "child_spans": [{"span_id": "2", "span_attributes": {"k": [1]}}, {"span_id": "3", "parent_span_id": "1"}]}]}
    rows = files(spark, talk, log, tree, OTLP, "[]", "")
    assert [r.d for r in rows.select(traces.dialect(F.col("value")).alias("d")).collect()] == ["dialogue", "events", "tree", "otlp", None, None]
    got = {t: [r for r in traces.read_traces(rows).orderBy("trace_id", "place").collect() if r.trace_id == t] for t in "qegt"}
    assert [(r.span_id, r.span_name) for r in got["q"]] == [("dlg0000000000000", "dialogue"), ("dlg0000000000001", "User"), ("dlg0000000000003", "Orchestrator")]
    assert got["q"][2].timestamp == "1970-01-01T00:00:00.300000Z"
    assert [(r.span_name, r.status_code) for r in got["e"]] == [("grep", "Ok"), ("z", "Error")] and got["e"][1].parent_span_id == got["e"][0].span_id
    assert [(r.span_id, r.parent_span_id) for r in got["g"]] == [("1", None), ("2", "1"), ("3", "1")] and got["g"][1].attributes == {"k": "[1]"}
    assert len(got["t"]) == 2


def test_read_files_strips_the_mark(spark, tmp_path):
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(OTLP).encode())
    (tmp_path / "a.json").write_text("{}")
    assert [r.path.rsplit("/", 1)[1] for r in traces.read_files(spark, str(tmp_path), 1).collect()] == ["a.json"]
    assert traces.otlp_spans(traces.read_files(spark, f"{tmp_path}/b.json")).count() == 2


def test_prometheus_cgroup_pods(spark):
    text = '# HELP x\nup 1\nutil{device="0",pod="a b"} 95.5 1700000000\nbad{x="1"} NaN\ninf 1e999\n\nnoise'
    got = [(r.name, r.labels, r.value) for r in metrics.prometheus(files(spark, text)).collect()]
    assert got == [("up", {}, 1.0), ("util", {"device": "0", "pod": "a b"}, 95.5)]
    rows = {r.key: r.value for r in metrics.cgroup(files(spark, "oom_kill 3\nnr 4", "max", "some avg10=1.50 total=7")).collect()}
    assert rows == {"oom_kill": 3.0, "nr": 4.0, "value": None, "some.avg10": 1.5}
    scrapes = spark.createDataFrame([("p", "k", 1, 5.0), ("p", "k", 2, 9.0), ("p", "k", 3, 2.0)], "path string, key string, seq int, value double")
    assert [r.delta for r in metrics.counter_growth(scrapes).orderBy("seq").collect()] == [0.0, 4.0, 0.0]
    pod = {"metadata": {"name": "p"}, "spec": {"containers": [{"name": "c", "resources": {"requests": {"cpu": "250m"}, "limits": {"memory": "1Gi"}}}]}, "status": {"phase": "Running", "containerStatuses": [{"name": "c", "ready": False, "restartCount": 3, "lastState": {"terminated": {"reason": "OOMKilled"}}}]}}
    (r,) = metrics.pods(files(spark, pod, "{}")).collect()
    assert (r.cpu_request, r.memory_limit, r.restarts, r.oom_killed, r.flags) == (0.25, 1024.0**3, 3, ["c"], ["restarts", "not_ready", "oom_killed"])


def test_lenient_json_and_numbers(spark):
    cases = {'```json\n{"a": 1,}\n```': '{"a":1}', "{'a': None}": '{"a":null}', 'text {"x": "}"} more': '{"x":"}"}', '"{\\"b\\": 2}"': '{"b":2}', "no": None, "": None}
    for text, want in cases.items():
        assert js.lenient(text) == want
    df = spark.createDataFrame([("PT1H2M3.5S", "250m"), ("P1DT1S", "1Gi"), ("2", "x"), ("PT", "100n"), (None, None)], "d string, q string")
    got = [(r.ms, r.q) for r in df.select(numbers.iso_duration_ms(F.col("d")).alias("ms"), numbers.k8s_quantity(F.col("q")).alias("q")).collect()]
    assert got[:3] == [(3723500.0, 0.25), (1000.0, 1024.0**3), (2000.0, None)] and got[3][0] == 0.0 and got[4] == (None, None)
