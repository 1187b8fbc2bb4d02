"""Monitoring events as streams: ingestion with rejects, de-duplication, windows, and state that is kept a system."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators import monitoring

EVENTS = "seq long, ts timestamp, system_id string, layer string, measurement double, uid string"


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """JSON lines that land in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def accepted(events: DataFrame) -> DataFrame:
    """Events that pass validation; works on streams and tables."""
    return monitoring.accepted(events)


def unique(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first event of each uid, within a watermark that bounds the state."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["uid"])


def windowed(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, mean and maximum of each system and layer in tumbling windows; later events than the watermark go."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "system_id", "layer")
    return w.agg(F.count("*").alias("n"), F.avg("measurement").alias("mean"), F.max("measurement").alias("most")).select(F.col("window.start").alias("start"), "system_id", "layer", "n", "mean", "most")


DELTA = "system_id string, layer string, seq long, delta double"
HELD = "last double, newest long, seqs array<long>, times array<long>, measurements array<double>"


def deltas(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Growth of the measurement of each system and layer since its event before by ``seq``.

    Events wait in the state until the watermark, ``late`` behind the newest ``ts``, has passed them, and then go out in the
    order of ``seq``, whatever the order in which they came. One that comes after the watermark, or with a ``seq`` below one
    that has gone out, is dropped. What waits is at most what arrives within ``late``.
    """

    def grow(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, newest, *waiting = state.get if state.exists else (None, None, [], [], [])
        rows = pd.DataFrame({"seq": waiting[0], "at": waiting[1], "measurement": waiting[2]}).astype({"seq": "int64", "at": "int64", "measurement": "float64"})
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for part in parts:
                fresh = pd.DataFrame({"seq": part["seq"], "at": part["ts"].astype("datetime64[ms]").astype("int64"), "measurement": part["measurement"]})
                rows = pd.concat([rows, fresh[fresh["at"] > mark]]) if len(rows) else fresh[fresh["at"] > mark]
        rows = rows.sort_values("seq", kind="stable")
        if newest is not None:
            rows = rows[rows["seq"] > newest]
        # a row goes out once no row with a lower seq can come: all up to the first that still waits
        waits = (rows["at"] > mark).to_numpy()
        n = int(waits.argmax()) if waits.any() else len(rows)
        ready, rows = rows.iloc[:n], rows.iloc[n:]
        if n:
            before = ready["measurement"].shift(fill_value=ready["measurement"].iloc[0] if last is None else last)
            last, newest = float(ready["measurement"].iloc[-1]), int(ready["seq"].iloc[-1])
            yield pd.DataFrame({"system_id": key[0], "layer": key[1], "seq": ready["seq"], "delta": (ready["measurement"] - before).clip(lower=0)})
        state.update((last, newest, rows["seq"].tolist(), rows["at"].tolist(), rows["measurement"].tolist()))
        if len(rows):
            state.setTimeoutTimestamp(max(int(rows["at"].max()), mark + 1))

    from pyspark.sql.streaming.state import GroupStateTimeout

    timed = events.withWatermark("ts", late)
    return timed.groupBy("system_id", "layer").applyInPandasWithState(grow, DELTA, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def ingest(events: DataFrame, accept: str, reject: str, checkpoint: str) -> StreamingQuery:
    """Writes accepted events and rejected ones, with the rule they break, to two folders; a batch is written once by its number."""

    def write(batch: DataFrame, number: int) -> None:
        rows = monitoring.validated(batch).persist()
        rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{accept}/batch={number}")
        rows.where("error is not null").write.mode("overwrite").parquet(f"{reject}/batch={number}")
        rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_snapshot(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest event of each system and layer in a table, merged batch by batch into a new version.

    A version is complete once Spark's success mark is there. A batch builds on the newest complete version before its own
    number, so a batch that is tried again, or a number that is left out, changes nothing; ``latest_snapshot`` reads the newest.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest = monitoring.accepted(batch).groupBy("system_id", "layer").agg(F.max("seq").alias("seq"), F.max_by("measurement", "seq").alias("measurement"))
        before = _newest(batch.sparkSession, path, number)
        if before is not None:
            latest = latest.unionByName(batch.sparkSession.read.parquet(f"{path}/version={before}"))
        latest.groupBy("system_id", "layer").agg(F.max("seq").alias("seq"), F.max_by("measurement", "seq").alias("measurement")).write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest complete version, of those below a number; read through Hadoop's file system, so it works wherever the table is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    names = [(f.getPath().getName(), f.getPath()) for f in system.listStatus(hadoop)]
    done = [int(n.removeprefix("version=")) for n, p in names if n.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((v for v in done if below is None or v < below), default=None)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table that ``keep_snapshot`` keeps; empty before the first."""
    newest = _newest(spark, path)
    if newest is None:
        return spark.createDataFrame([], "system_id string, layer string, seq long, measurement double")
    return spark.read.parquet(f"{path}/version={newest}")


def poll(collect: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], rounds: int, interval: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Collects and hands on ``rounds`` times, one second apart at least; a round that fails is left out. Returns the rounds that did not."""
    good = 0
    for k in range(rounds):
        try:
            sink(collect(), k)
            good += 1
        except Exception:  # a later round may succeed
            pass
        if k < rounds - 1:
            sleep(max(1.0, interval))
    return good


def store_by_trace(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends spans to a table that is split by a hash of the trace."""
    rows = spans.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(64)))
    return rows.writeStream.partitionBy("bucket").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_all(collectors: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """Events of all collectors together and a health row each; one that fails gives its error and stops none."""
    out = spark.createDataFrame([], "collector string, healthy boolean, error string, system_id string, layer string, measurement double")
    for name, collect in collectors.items():
        try:
            rows = collect().select(F.lit(name).alias("collector"), F.lit(True).alias("healthy"), F.lit(None).cast("string").alias("error"), "system_id", "layer", "measurement")
            out = out.unionByName(rows).unionByName(spark.createDataFrame([(name, True, None, None, "health", None)], out.schema))
        except Exception as e:
            out = out.unionByName(spark.createDataFrame([(name, False, str(e)[:200], None, "health", None)], out.schema))
    return out


def post_events(events: DataFrame, post: Callable[[list[dict]], None], checkpoint: str, most: int = 1000) -> StreamingQuery:
    """Hands accepted events on, ``most`` at a time, from the tasks that hold them; a batch whose post fails is tried again as a whole, so ``post`` must allow repeats."""

    def send(batch: DataFrame, number: int) -> None:
        columns = batch.columns

        def each(rows: Iterator) -> None:
            part: list[dict] = []
            for r in rows:
                part.append({c: r[c] for c in columns})
                if len(part) == most:
                    post(part)
                    part = []
            if part:
                post(part)

        monitoring.accepted(batch).foreachPartition(each)

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
