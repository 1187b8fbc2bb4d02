"""Traces among other data: rows of data sets, annotations, stored graphs, and payloads that a receiver takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns that may hold an annotation or an id, by rank.
ANNOTATION_COLUMNS = ("processed_annotations_gaia", "processed_annotations_swe_bench", "processed_annotation", "annotations", "annotation", "error", "errors")
ID_COLUMNS = ("trace_id", "task_id", "id", "example_id", "uuid")


def splits(tables: dict[str, DataFrame], order: str, first: int | None = None) -> DataFrame:
    """Rows of all splits of a data set with ``split`` and ``idx``, their place by ``order``; of each split the first few if asked for.

    Columns that a split lacks are null.
    """
    out = None
    for name, table in tables.items():
        rows = table.withColumn("split", F.lit(name)).withColumn("idx", F.row_number().over(Window.partitionBy("split").orderBy(order)) - 1)
        rows = rows.where(F.col("idx") < first) if first is not None else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def annotation_column(rows: DataFrame) -> Column:
    """The first of the columns that may hold an annotation that is there, even if it is null."""
    return next((F.col(c).cast("string") for c in ANNOTATION_COLUMNS if c in rows.columns), F.lit(None).cast("string"))


def sample_id(rows: DataFrame, place: Column) -> Column:
    """The first id of a row that isn't empty, else one of its place."""
    held = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ID_COLUMNS if c in rows.columns]
    return F.coalesce(*held, F.concat(F.lit("sample_"), F.lpad(place.cast("string"), 5, "0")))


def stem(path: Column) -> Column:
    """Name of a file without folders and its last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def annotated(traces: DataFrame, files: DataFrame) -> DataFrame:
    """Traces (trace_id) with the annotation file (path, value) of their name, and whether there is a readable one."""
    notes = files.select(stem(F.col("path")).alias("trace_id"), F.col("value").alias("annotation"))
    out = traces.withColumn("trace_id", F.col("trace_id").cast("string")).join(notes, "trace_id", "left")
    return out.withColumn("status", F.when(F.col("annotation").isNull(), "no annotation").when(F.try_parse_json("annotation").isNull(), "unreadable annotation").otherwise("ok"))


def graph_of(traces: DataFrame, files: DataFrame) -> DataFrame:
    """The graph file (path, value) of each trace (trace_id): ``local_<id>_graph.json``, else the first by name that holds the id."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = files.select(name.alias("file"), F.col("value").alias("graph"))
    exact = named.select(F.regexp_extract("file", r"^local_(.*)_graph\.json$", 1).alias("trace_id"), "file", "graph").where("trace_id != ''")
    ids = traces.select(F.col("trace_id").cast("string").alias("trace_id"))
    direct = ids.join(exact, "trace_id")
    # other names hold the id as one of their parts
    parts = named.where("file like '%.json'").select("file", "graph", F.explode(F.array_distinct(F.split(F.regexp_replace("file", r"\.json$", ""), r"[^A-Za-z0-9]+"))).alias("trace_id"))
    rest = ids.join(direct.select("trace_id"), "trace_id", "left_anti").join(parts, "trace_id")
    rest = rest.groupBy("trace_id").agg(F.min_by(F.struct("file", "graph"), "file").alias("x")).select("trace_id", "x.*")
    return ids.join(direct.unionByName(rest), "trace_id", "left")


def first_graph(full: DataFrame, pruned: DataFrame, suspicious: DataFrame, mode: str = "agenttrace_first") -> DataFrame:
    """The graph (trace_id, graph) that a judge gets: the whole one, the pruned one, or the suspicious paths with the others behind them."""
    if mode not in ("full", "pruning", "agenttrace_first"):
        raise ValueError(f"unknown mode {mode!r}; known: full, pruning, agenttrace_first")
    out = full.select("trace_id", F.col("graph").alias("f")).join(pruned.select("trace_id", F.col("graph").alias("p")), "trace_id", "full").join(suspicious.select("trace_id", F.col("graph").alias("s")), "trace_id", "full")
    order = {"full": ("f",), "pruning": ("p", "f"), "agenttrace_first": ("s", "p", "f")}[mode]
    source = F.lit(None).cast("string")
    for c, label in reversed([(c, {"f": "full", "p": "pruning", "s": "suspicious"}[c]) for c in order]):
        source = F.when(F.col(c).isNotNull(), label).otherwise(source)
    return out.select("trace_id", F.coalesce(*order).alias("graph"), source.alias("graph_source")).where("graph is not null")


def hex_id(value: Column) -> Column:
    """An id in hex, from one that is so already (lower-cased) or in base64."""
    return F.when(value.rlike(r"^(?:[0-9a-fA-F]{16}|[0-9a-fA-F]{32})$"), F.lower(value)).otherwise(F.lower(F.hex(F.try_to_binary(value, F.lit("base64")))))


PAYLOAD = "resourceSpans array<struct<resource:string,scopeSpans:array<struct<scope:string,spans:array<string>>>>>"


def by_trace(payloads: DataFrame) -> DataFrame:
    """OTLP payloads (value) cut by trace: trace_id, n_spans and one payload of the spans of that trace, resources and scopes kept."""
    x = payloads.select(F.monotonically_increasing_id().alias("p"), F.from_json("value", PAYLOAD).alias("x")).select("p", F.posexplode("x.resourceSpans").alias("r", "rs"))
    x = x.select("p", "r", F.col("rs.resource").alias("resource"), F.posexplode("rs.scopeSpans").alias("s", "ss")).select("p", "r", "s", "resource", F.col("ss.scope").alias("scope"), F.posexplode("ss.spans").alias("i", "span"))
    x = x.withColumn("trace_id", hex_id(F.get_json_object("span", "$.traceId"))).where("trace_id is not null and trace_id != ''")
    scope = x.groupBy("trace_id", "p", "r", "s", "resource", "scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "span"))), lambda k: k["span"]), ",").alias("spans"), F.count("*").alias("n"))
    part = F.concat(F.lit('{"resource":'), F.coalesce("resource", F.lit("{}")), F.lit(',"scopeSpans":[{"scope":'), F.coalesce("scope", F.lit("{}")), F.lit(',"spans":['), "spans", F.lit("]}]}"))
    rows = scope.groupBy("trace_id").agg(F.sum("n").alias("n_spans"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "r", "s", part.alias("part")))), lambda k: k["part"]), ",").alias("parts"))
    return rows.select("trace_id", "n_spans", F.concat(F.lit('{"resourceSpans":['), "parts", F.lit("]}")).alias("payload"))


def manifest(stored: DataFrame) -> DataFrame:
    """What a store of payloads by trace holds: payloads and spans of each trace."""
    return stored.groupBy("trace_id").agg(F.count("*").alias("payloads"), F.sum("n_spans").alias("n_spans"))


def landed(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Payloads that a receiver puts into a folder, as a stream of whole files (value)."""
    return spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_trigger).text(folder)


def uploaded(files: DataFrame, most: int = 50) -> DataFrame:
    """Files of one request (path, value) with ``ok`` and ``error``: one that is empty, no JSON, or beyond the first ``most`` by name fails alone."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path"))  # one request
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    error = F.when(place > most, f"more than {most} files").when(blank, "empty file").when(F.try_parse_json("value").isNull(), "no JSON")
    return files.withColumn("error", error).withColumn("ok", F.col("error").isNull())


GRAPH = "nodes array<struct<id:string,type:string,content:string,saliency:double,span_id:string>>, edges array<struct<source:string,target:string,edge_type:string,score:double>>"


def graph_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of exported graphs (trace_id, value): any tool's choice of a graph can go on from these.

    Nodes without an id go; edges whose ends aren't nodes of the graph too.
    """
    x = files.select("trace_id", F.from_json("value", GRAPH).alias("g"))
    nodes = x.select("trace_id", F.posexplode("g.nodes").alias("ord", "n")).select("trace_id", F.col("n.id").alias("node_id"), F.col("ord") + 1, F.col("n.type").alias("type"), F.coalesce("n.content", F.lit("")).alias("content"), F.coalesce("n.saliency", F.lit(0.0)).alias("saliency"), F.col("n.span_id").alias("span_id"))
    nodes = nodes.toDF("trace_id", "node_id", "ord", "type", "content", "saliency", "span_id").where("coalesce(node_id, '') != ''")
    edges = x.select("trace_id", F.explode("g.edges").alias("e")).select("trace_id", "e.source", "e.target", F.coalesce("e.edge_type", F.lit("Temporal")).alias("edge_type"), F.coalesce("e.score", F.lit(0.0)).alias("score"))
    for end in ("source", "target"):
        edges = edges.join(nodes.select("trace_id", F.col("node_id").alias(end)), ["trace_id", end], "left_semi")
    return nodes, edges.select("trace_id", "source", "target", "edge_type", "score")
