"""Monitoring: events of four layers, their roll-ups, and collectors' samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers

LAYERS = ("hardware", "virtualization", "communication", "application")


def validated(events: DataFrame) -> DataFrame:
    """Events with ``error``: null if accepted, else the first rule that they break."""
    error = F.when(F.col("system_id").isNull() | (F.trim("system_id") == ""), "system_id is required").when(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False)), "unknown layer").when(F.col("ts").isNull(), "invalid timestamp")
    return events.withColumn("error", error)


def accepted(events: DataFrame) -> DataFrame:
    """Events without fault."""
    return validated(events).where("error is null").drop("error")


def retained(events: DataFrame, most: int = 20_000) -> DataFrame:
    """The newest events by ingestion."""
    return events.orderBy(F.desc("seq")).limit(most)


def in_range(events: DataFrame, system_id: str | None = None, layer: str | None = None, since: str | None = None, until: str | None = None, limit: int = 5000) -> DataFrame:
    """Newest events of a system and layer between two times, both included, in order of ingestion."""
    for column, value in (("system_id", system_id), ("layer", layer)):
        events = events.where(F.col(column) == value) if value is not None else events
    events = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else events
    events = events.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz")) if until else events
    return events.orderBy(F.desc("seq")).limit(max(1, min(limit, 5000))).orderBy("seq")


def snapshot(events: DataFrame) -> DataFrame:
    """The latest event of every layer by ingestion, for each system; layers without one have nulls."""
    latest = events.groupBy("system_id", "layer").agg(F.max("seq").alias("seq"), F.max_by("measurement", "seq").alias("measurement"), F.count("*").alias("n_events"))
    layers = F.array(*[F.lit(x) for x in LAYERS])
    every = events.select("system_id").distinct().select("system_id", F.explode(layers).alias("layer"))
    return every.join(latest, ["system_id", "layer"], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def layer_rollup(events: DataFrame, warn: float = 80, critical: float = 95) -> DataFrame:
    """Of each system: its worst layer status by mean measurement, and the share of layers with events."""
    means = snapshot(events).select("system_id", "layer").join(events.groupBy("system_id", "layer").agg(F.round(F.avg("measurement"), 4).alias("mean")), ["system_id", "layer"], "left")
    rank = F.lit(0)
    for name, value in numbers.STATUS_RANK.items():
        rank = F.when(numbers.threshold_status(F.col("mean"), warn, critical) == name, value).otherwise(rank)
    worst = means.groupBy("system_id").agg(F.max(rank).alias("r"), numbers.percent(F.count("mean"), F.count("*")).alias("coverage"))
    status = F.element_at(F.array(*[F.lit(x) for x in numbers.STATUS_RANK]), F.col("r") + 1)
    return worst.select("system_id", status.alias("status"), "coverage")


def latency(spans: DataFrame) -> DataFrame:
    """Of each trace: spans, errors, error rate, retries, and interpolated latency percentiles in ms."""
    again = F.row_number().over(Window.partitionBy("trace_id", "tool").orderBy("pos")) > 1
    rows = spans.withColumn("again", again)
    ms = F.col("duration") * 1000
    out = rows.groupBy("trace_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "Error").alias("errors"), F.count_if("again").alias("retries"),
        F.round(F.percentile(ms, F.lit(0.5)), 2).alias("p50_ms"), F.round(F.percentile(ms, F.lit(0.95)), 2).alias("p95_ms"), F.count_distinct("tool").alias("protocols"),
    )
    rate = numbers.percent(F.col("errors"), F.col("total"))
    status = F.when(rate.isNull(), "unknown").when(rate >= 20, "critical").when((rate > 0) | (F.col("retries") > 0), "warning").otherwise("ok")
    return out.withColumn("error_rate", rate).withColumn("status", status)


def counter_deltas(samples: DataFrame, value: str = "value") -> DataFrame:
    """Counters with their growth since the previous sample; 0 for the first and after a reset."""
    before = F.lag(value).over(Window.partitionBy("trace_id", "tool").orderBy("pos"))
    return samples.withColumn("delta", F.greatest(F.col(value) - F.coalesce(before, F.col(value)), F.lit(0.0)))


def accelerators(samples: DataFrame) -> DataFrame:
    """Of each pod: devices, mean and peak utilisation, peak temperature, memory, and devices with errors. A device's last sample of a metric counts."""
    last = samples.groupBy("pod", "device", "metric").agg(F.max_by("value", "pos").alias("value"))
    wide = last.groupBy("pod", "device").pivot("metric", ["utilization", "memory_used", "temperature", "errors"]).agg(F.first("value"))
    return wide.groupBy("pod").agg(
        F.count("*").alias("devices"), F.round(F.avg("utilization"), 4).alias("mean_utilization"), F.max("utilization").alias("max_utilization"),
        F.max("temperature").alias("max_temperature"), F.sum("memory_used").alias("memory_used"), F.count_if(F.col("errors") != 0).alias("error_devices"),
    )


def correlated(events: DataFrame, spans: DataFrame, seconds: int = 300) -> DataFrame:
    """Monitoring events near a failed span of the same system, by time buckets: no pairs beyond neighbouring buckets."""
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    failed = spans.where("status = 'Error'").select(F.col("trace_id").cast("string").alias("system_id"), "span_id", F.col("ts").alias("at"), F.explode(F.array(bucket("ts") - 1, bucket("ts"), bucket("ts") + 1)).alias("bucket"))
    both = events.withColumn("bucket", bucket("ts")).join(failed, ["system_id", "bucket"])
    gap = F.abs(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp")))
    return both.where(gap <= seconds).groupBy("system_id", "layer").agg(F.count_distinct("seq").alias("events"), F.count_distinct("span_id").alias("failed_spans"))


def application(spans: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The application layer of each trace: spans, model and tool calls, failed spans, nodes, errors and edges, and its status.

    ``spans``: trace_id, name, tool, status. Critical with any failure, healthy without, unknown where there is nothing to see.
    """
    s = spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"), F.count_if(F.col("name") == "LiteLLMModel.__call__").alias("llm_calls"),
        F.count_if((F.coalesce("tool", F.lit("")) != "") | F.col("name").endswith("Tool")).alias("tool_calls"), F.count_if(F.lower("status") == "error").alias("failed_spans"),
    )
    n = nodes.groupBy("trace_id").agg(F.count("*").alias("node_count"), F.count_if(F.col("type") == "Error").alias("error_nodes"))
    e = edges.groupBy("trace_id").agg(F.count("*").alias("edge_count"))
    out = s.join(n, "trace_id", "full").join(e, "trace_id", "left").na.fill(0)
    bad, seen = (F.col("failed_spans") > 0) | (F.col("error_nodes") > 0), (F.col("span_count") > 0) | (F.col("node_count") > 0)
    return out.withColumn("status", F.when(bad, "critical").when(seen, "healthy").otherwise("unknown"))


def accelerator_flags(samples: DataFrame, kind: str = "gpu") -> DataFrame:
    """Of each pod, its devices' state and what is wrong: saturated at 95 %, too hot at 85 (gpu) or 90 degrees, with errors, or unhealthy.

    ``samples``: pod, device, metric, value, pos; a device's last sample of a metric counts. A device without a ``health`` sample is healthy.
    """
    last = samples.groupBy("pod", "device", "metric").agg(F.max_by("value", "pos").alias("value"))
    wide = last.groupBy("pod", "device").pivot("metric", ["utilization", "memory_used", "temperature", "errors", "health", "power"]).agg(F.first("value"))
    out = wide.groupBy("pod").agg(
        F.count("*").alias("device_count"), F.round(F.avg("utilization"), 2).alias("utilization_avg"), F.max("utilization").alias("utilization_max"), F.max("temperature").alias("temperature_max"),
        F.sum("power").alias("power_total"), F.count_if(F.col("errors") != 0).alias("error_devices"), F.count_if(F.col("health") <= 0).alias("unhealthy_devices"),
    )
    limit = 85 if kind == "gpu" else 90
    flags = F.array_compact(F.array(F.when(F.col("utilization_max") >= 95, "utilization_saturated"), F.when(F.col("temperature_max") >= limit, "temperature_critical"), F.when(F.col("error_devices") > 0, "device_error"), F.when(F.col("unhealthy_devices") > 0, "device_unhealthy")))
    return out.withColumn("flags", flags)


def label_of(labels: Column, keys: tuple[str, ...]) -> Column:
    """The first of the labels that isn't empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit("")), F.lit("")) for k in keys], F.lit(""))


# Labels that name pods, namespaces and devices.
POD_LABELS, SPACE_LABELS, DEVICE_LABELS = ("pod", "pod_name"), ("namespace", "pod_namespace"), ("UUID", "gpu", "device", "npu_id", "id", "chip_id")


def scoped_samples(samples: DataFrame, pods: DataFrame) -> DataFrame:
    """Of each asked pod (pod, namespace), the samples (labels, name, value) of it and of its devices, with scope ``pod``.

    A pod that no sample names has one row of scope ``exporter`` with nulls: all samples of the exporter stand for it.
    """
    rows = samples.select("*", label_of(F.col("labels"), POD_LABELS).alias("_pod"), label_of(F.col("labels"), SPACE_LABELS).alias("_space"), label_of(F.col("labels"), DEVICE_LABELS).alias("_device"), F.monotonically_increasing_id().alias("_row"))
    asked = pods.select(F.col("pod").alias("asked"), F.coalesce("namespace", F.lit("")).alias("space"))
    own = asked.join(rows, (F.col("asked") == F.col("_pod")) & ((F.col("space") == "") | F.col("_space").isin("") | (F.col("_space") == F.col("space"))))
    devices = own.where("_device != ''").select("asked", "_device").distinct()
    shared = devices.join(rows, "_device")
    named = own.select("asked", *rows.columns).unionByName(shared.select("asked", *rows.columns)).dropDuplicates(["asked", "_row"]).withColumn("scope", F.lit("pod"))
    rest = asked.select("asked").join(named.select("asked").distinct(), "asked", "left_anti")
    return named.select("asked", "scope", *samples.columns).unionByName(rest.withColumn("scope", F.lit("exporter")), allowMissingColumns=True)


def host_status(probes: DataFrame) -> DataFrame:
    """Host probes (system_id, cpu, memory, disk in per cent) with a status each and the worst of all: warnings from 80 (disk 85), critical from 95."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in numbers.STATUS_RANK]), c)
    parts = {c: numbers.threshold_status(F.col(c), w, 95) for c, w in (("cpu", 80), ("memory", 80), ("disk", 85))}
    rows = probes.select("system_id", *[v.alias(f"{k}_status") for k, v in parts.items()])
    worst = F.greatest(*[rank(F.col(f"{k}_status")) for k in parts])
    return rows.withColumn("status", F.element_at(F.array(*[F.lit(x) for x in numbers.STATUS_RANK]), worst.cast("int")))
