"""Command line: ``python -m spanloom.cli COMMAND INPUT OUTPUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import graph, reports, semantics, spans, strategies, target_paths
from spanloom.sources import traces


def tool_spans(canonical: DataFrame) -> DataFrame:
    """Canonical spans in the columns of the fault and graph operators."""
    a = F.col("attributes")
    order = F.row_number().over(Window.partitionBy("trace_id").orderBy("timestamp", "place"))
    final = (F.col("span_name") == "final") | (a["chat.role"] == "assistant")
    return canonical.select(
        "trace_id", "span_id", F.col("parent_span_id").alias("parent_id"), F.try_to_timestamp("timestamp").alias("ts"), order.alias("pos"), F.coalesce(a["tool.name"], "span_name").alias("tool"),
        F.coalesce(a["input.value"], F.lit("")).alias("input"), F.coalesce(a["output.value"], F.lit("")).alias("content"), F.lit(0.0).alias("duration"), F.when(F.col("status_code") == "Error", "Error").otherwise("Ok").alias("status"), F.coalesce(final, F.lit(False)).alias("is_final"),
    )


def named_spans(canonical: DataFrame) -> DataFrame:
    """Canonical spans in the columns of semantic validation."""
    return canonical.select("trace_id", "span_id", F.col("parent_span_id").alias("parent_id"), F.col("timestamp").alias("ts"), F.col("place").alias("pos"), F.col("span_name").alias("name"), F.col("status_code").alias("status"), "attributes")


def numbered(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with saliency and edges of tool spans, with nodes numbered by their order."""
    rows = s.withColumn("node", F.col("pos").cast("long"))
    up = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.col("node").alias("_up"))
    rows = rows.join(up, ["trace_id", "parent_id"], "left").drop("parent_id", "span_id").withColumnsRenamed({"node": "span_id", "_up": "parent_id"})
    nodes, edges = graph.span_graph(rows)
    return graph.saliency(nodes), edges


def diagnosed(s: DataFrame) -> DataFrame:
    """A Markdown diagnosis of each trace from its judgement, its paths and its rules."""
    key = F.col("trace_id").cast("string")
    causes = reports.root_cause_rows(reports.judged(reports.digest(s))).withColumn("trace_id", key)
    chains = target_paths.rows_of(target_paths.found_paths(*numbered(s)), "chains")
    return reports.diagnostic_markdown(spans.fault_findings(s), causes, chains.select("trace_id", "rank", "path", "score"))


def main(argv: list[str] | None = None) -> None:
    """Reads traces and writes spans, faults, reports, graphs or pruned graphs as a table."""
    parser = argparse.ArgumentParser(prog="spanloom")
    parser.add_argument("command", choices=["spans", "faults", "report", "graph", "mermaid", "digest", "judge", "validate", "prune", "paths", "summary", "diagnose"])
    parser.add_argument("input", help="folder or pattern of trace files")
    parser.add_argument("output", help="folder of the resulting parquet table")
    parser.add_argument("--strategy", default="tg_spe", help="pruning strategy, for prune")
    parser.add_argument("--resume", action="store_true", help="only traces that the output lacks")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = traces.read_traces(traces.read_files(spark, args.input))
    if args.resume:
        rows = reports.still_to_do(rows, spark.read.parquet(args.output))
    s = tool_spans(rows)
    made = {
        "spans": lambda: rows, "faults": lambda: spans.fault_findings(s), "report": lambda: reports.markdown_report(spans.fault_findings(s)), "graph": lambda: reports.graph_json(*graph.span_graph(s)),
        "mermaid": lambda: reports.mermaid(*graph.span_graph(s)), "digest": lambda: reports.digest(s), "judge": lambda: reports.judged(reports.digest(s)),
        "validate": lambda: semantics.validate(semantics.steps(named_spans(rows)))["checks"], "prune": lambda: strategies.pruned(*numbered(s), args.strategy), "paths": lambda: target_paths.rows_of(target_paths.found_paths(*numbered(s)), "ranking"),
        "summary": lambda: graph.summary(*graph.span_graph(s)), "diagnose": lambda: diagnosed(s),
    }[args.command]()
    made.write.mode("append" if args.resume else "overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
