"""A thin HTTP service over the operators: requests in, JSON out. Optional; nothing else uses it."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.operators import digests, graph, monitoring, reports, spans
from spanloom.sources import datasets, traces

#: Events that one request may hold, and events that are kept.
BATCH, KEPT = 1000, 20_000
EVENT = "seq long, ts timestamp, system_id string, layer string, measurement double"


class Service:
    """The newest events, and the answers to requests. Each trace that is sent is read by itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.events = spark, []
        self.routes: dict[tuple[str, str], Callable[[dict, object], tuple[int, object]]] = {
            ("GET", "/api/health"): lambda q, b: (200, {"ok": True, "events": len(self.events)}),
            ("POST", "/api/parse"): lambda q, b: self.parse([{"path": "upload.json", "value": json.dumps(b)}]),
            ("POST", "/api/upload"): lambda q, b: self.parse(b if isinstance(b, list) else []),
            ("POST", "/api/faults"): lambda q, b: (200, self.rows(spans.fault_findings(self.tools(b)))),
            ("POST", "/api/judge"): lambda q, b: (200, self.rows(reports.judged(reports.digest(self.tools(b))))),
            ("POST", "/api/report"): lambda q, b: (200, self.rows(cli.diagnosed(self.tools(b)))),
            ("POST", "/api/events"): lambda q, b: self.ingest(b),
            ("GET", "/api/events"): lambda q, b: (200, self.rows(monitoring.in_range(self.table(), q.get("system_id"), q.get("layer"), limit=int(q.get("limit", 500))))),
            ("GET", "/api/snapshot"): lambda q, b: (200, self.rows(monitoring.snapshot(self.table()))),
        }

    def rows(self, df: DataFrame) -> list[dict]:
        """Rows as JSON values; answers are as large as one request's traces."""
        return [json.loads(x) for x in df.toJSON().collect()]

    def table(self) -> DataFrame:
        """The events that are kept."""
        return self.spark.createDataFrame(self.events, EVENT)

    def tools(self, body: object) -> DataFrame:
        """The spans of the trace in a request."""
        return cli.tool_spans(traces.read_traces(self.spark.createDataFrame([("request", json.dumps(body))], "path string, value string")))

    def parse(self, files: list[dict]) -> tuple[int, object]:
        """Graphs of the files that can be read, and the errors of those that can't."""
        table = datasets.uploaded(self.spark.createDataFrame([(str(f.get("path")), f.get("value")) for f in files], "path string, value string"))
        s = cli.tool_spans(traces.read_traces(table.where("ok").select("path", "value")))
        nodes, edges = graph.span_graph(s)
        view = digests.view_payload(nodes, edges, s.withColumn("name", F.col("tool")))
        return 200, {"graphs": self.rows(view), "errors": self.rows(table.where("not ok").select("path", "error"))}

    def ingest(self, body: object) -> tuple[int, object]:
        """Takes valid events in, and says what is wrong with the others."""
        sent = body if isinstance(body, list) else [body]
        if len(sent) > BATCH:
            return 413, {"error": f"more than {BATCH} events"}
        number = self.events[-1][0] + 1 if self.events else 0
        rows = [(number + i, e.get("ts"), e.get("system_id"), e.get("layer"), e.get("measurement")) if isinstance(e, dict) else (number + i, None, None, None, None) for i, e in enumerate(sent)]
        read = self.spark.createDataFrame(rows, EVENT.replace("ts timestamp", "ts string")).withColumn("ts", F.try_to_timestamp("ts"))
        checked = monitoring.validated(read).orderBy("seq").collect()
        self.events = (self.events + [tuple(r)[:5] for r in checked if r.error is None])[-KEPT:]
        return 200, {"accepted": sum(r.error is None for r in checked), "rejected": [{"index": r.seq - number, "error": r.error} for r in checked if r.error]}

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        """Status and JSON value for a request."""
        url = urlsplit(target)
        route = self.routes.get((method, url.path))
        if route is None:
            return 404, {"error": "no such route"}
        try:
            return route({k: v[-1] for k, v in parse_qs(url.query).items()}, json.loads(body) if body else None)
        except ValueError as e:
            return 400, {"error": str(e)[:200]}


def serve(spark: SparkSession, port: int = 8000) -> None:
    """Answers requests until it is stopped."""
    service = Service(spark)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            status, value = service.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
