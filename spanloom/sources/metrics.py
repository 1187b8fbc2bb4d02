"""Readers of metrics: Prometheus text, control-group files and Kubernetes pods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import numbers

SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+([^\s]+)(?:\s+\d+)?\s*$"


def prometheus(files: DataFrame) -> DataFrame:
    """Samples (path, place, name, labels, value) of Prometheus text; comments, blank lines, NaN and infinities are left out."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")).where("trim(line) != '' and not startswith(trim(line), '#')")
    part = lambda i: F.regexp_extract("line", SAMPLE, i)
    names, values = F.regexp_extract_all(part(2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 1), F.regexp_extract_all(part(2), F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'), 2)
    rows = lines.select("path", "place", part(1).alias("name"), F.map_from_arrays(names, values).alias("labels"), part(3).try_cast("double").alias("value"))
    return rows.where("name != '' and value is not null and not isnan(value) and abs(value) < double('inf')")


def cgroup(files: DataFrame) -> DataFrame:
    """Rows (path, key, value) of flat control-group files: ``key value`` lines, single numbers, and pressure averages; ``max`` is null."""
    lines = files.select("path", F.explode(F.split("value", r"\n")).alias("line")).where("trim(line) != ''")
    pressure = F.col("line").rlike(r"^(some|full) ")
    key = F.when(pressure, F.concat(F.split("line", " ")[0], F.lit("."), F.split(F.split("line", " ")[1], "=")[0])).when(F.col("line").contains(" "), F.split("line", " ")[0]).otherwise("value")
    value = F.when(pressure, F.split(F.split("line", " ")[1], "=")[1]).when(F.col("line").contains(" "), F.split("line", " ")[1]).otherwise(F.trim("line"))
    return lines.select("path", key.alias("key"), value.try_cast("double").alias("value"))


def counter_growth(scrapes: DataFrame) -> DataFrame:
    """Growth of each counter (path, key) since the scrape before (``seq``); 0 for the first and after a reset."""
    before = F.lag("value").over(Window.partitionBy("path", "key").orderBy("seq"))
    return scrapes.withColumn("delta", F.greatest(F.col("value") - F.coalesce(before, F.col("value")), F.lit(0.0)))


def cgroup_flags(oom_delta: Column, memory: Column, limit: Column, throttled_delta: Column) -> Column:
    """What is wrong with a container: out of memory, close to its limit, or throttled."""
    return F.array_compact(F.array(F.when(oom_delta > 0, "oom"), F.when(F.try_divide(memory, limit) >= 0.9, "memory_pressure"), F.when(throttled_delta > 0, "throttled")))


POD = "metadata struct<name:string,namespace:string,uid:string>, spec struct<containers:array<struct<name:string,resources:struct<requests:map<string,string>,limits:map<string,string>>>>>, status struct<phase:string,containerStatuses:array<struct<name:string,ready:boolean,restartCount:int,lastState:struct<terminated:struct<reason:string>>>>>"


def pods(files: DataFrame) -> DataFrame:
    """A row a pod: requests and limits summed over containers, restarts, containers killed for memory, and flags."""
    x = files.select(F.from_json("value", POD).alias("x")).where("x.metadata.name is not null").select("x.*")
    total = lambda part, key: F.aggregate(F.coalesce("spec.containers", F.array()), F.lit(0.0), lambda a, c: a + F.coalesce(numbers.k8s_quantity(c["resources"][part][key]), F.lit(0.0)))
    status = F.col("status.containerStatuses")
    restarts = F.aggregate(F.coalesce(status, F.array()), F.lit(0), lambda a, c: a + F.coalesce(c["restartCount"], F.lit(0)))
    killed = F.transform(F.filter(status, lambda c: c["lastState"]["terminated"]["reason"] == "OOMKilled"), lambda c: c["name"])
    flags = F.array_compact(F.array(F.when(restarts >= 3, "restarts"), F.when(F.exists(status, lambda c: ~c["ready"]), "not_ready"), F.when(F.col("status.phase").isin("Failed", "Unknown"), "phase"), F.when(F.size(killed) > 0, "oom_killed")))
    return x.select(F.col("metadata.name").alias("pod"), F.col("status.phase").alias("phase"), total("requests", "cpu").alias("cpu_request"), total("limits", "cpu").alias("cpu_limit"), total("requests", "memory").alias("memory_request"), total("limits", "memory").alias("memory_limit"), restarts.alias("restarts"), F.coalesce(killed, F.array().cast("array<string>")).alias("oom_killed"), F.coalesce(flags, F.array().cast("array<string>")).alias("flags"))


def safe_endpoint(url: Column) -> Column:
    """A URL without user and query."""
    return F.regexp_replace(F.regexp_replace(url, r"//[^/@]*@", "//"), r"[?#].*$", "")
