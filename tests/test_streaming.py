"""Streams give what the batch operators give on the same events."""

import json
import os

from pyspark.sql import functions as F

from spanloom.operators import monitoring
from spanloom.streaming import monitor


def rows():
    out = [{"seq": i, "ts": f"2024-01-01T00:{i % 60:02d}:00Z", "system_id": f"s{i % 2}", "layer": "hardware" if i % 3 else "application", "measurement": float(i % 7), "uid": f"u{i // 2}"} for i in range(60)]
    return [*out, {"seq": 60, "ts": "2024-01-01T01:00:00Z", "system_id": "", "layer": "hardware", "measurement": 1.0, "uid": "x"}, {"seq": 61, "ts": "2024-01-01T01:00:00Z", "system_id": "s0", "layer": "moon", "measurement": 1.0, "uid": "y"}]


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(r) for r in rows()[k * 31 : k * 31 + 31]))
    return str(tmp_path / "in")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}")


def test_ingest_splits_accepted_and_rejected(spark, tmp_path):
    q = monitor.ingest(monitor.read_events(spark, folder(tmp_path), 1), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 60
    assert {r.error for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {"system_id is required", "unknown layer"}


def test_snapshot_equals_batch(spark, tmp_path):
    path = folder(tmp_path)
    monitor.keep_snapshot(monitor.read_events(spark, path, 1), f"{tmp_path}/snap", f"{tmp_path}/c").awaitTermination()
    got = {(r.system_id, r.layer): r.seq for r in spark.read.parquet(f"{tmp_path}/snap/version=1").collect()}
    batch = monitoring.snapshot(monitoring.accepted(spark.read.schema(monitor.EVENTS).json(path))).where("seq is not null")
    assert got == {(r.system_id, r.layer): r.seq for r in batch.collect()} and len(got) == 4


def test_unique_windows_and_deltas(spark, tmp_path):
    path = folder(tmp_path)
    events = lambda: monitor.accepted(monitor.read_events(spark, path, 1))
    assert run(monitor.unique(events()), "u").count() == 30
    got = run(monitor.windowed(events()), "w", "complete").agg(F.sum("n")).first()[0]
    assert got == 60


def test_deltas_whatever_the_order_of_files(spark, tmp_path):
    """Files read in either order give the same growth, by seq, for all events that the watermark has passed."""
    good = [x for x in rows() if x["system_id"] and x["layer"] != "moon"]
    last, want = {}, {}
    for r in good:
        k = r["system_id"], r["layer"]
        want[r["seq"]] = max(0.0, r["measurement"] - last.get(k, r["measurement"]))
        last[k] = r["measurement"]
    for name, order in (("up", (0, 1)), ("down", (1, 0))):
        (tmp_path / name).mkdir()
        for when, k in enumerate(order):
            f = tmp_path / name / f"{k}.json"
            f.write_text("\n".join(json.dumps(r) for r in good[k * 30 : k * 30 + 30]))
            os.utime(f, (1_700_000_000 + when, 1_700_000_000 + when))
        for when, hour in ((2, 5), (3, 9)):  # much later, so that the watermark passes all else
            f = tmp_path / name / f"end{hour}.json"
            f.write_text("\n".join(json.dumps({**r, "seq": 1000 + hour * 10 + i, "ts": f"2024-01-01T{hour:02d}:00:00Z"}) for i, r in enumerate(good[:6])))
            os.utime(f, (1_700_000_000 + when, 1_700_000_000 + when))
        events = monitor.accepted(monitor.read_events(spark, str(tmp_path / name), 1))
        got = {r.seq: r.delta for r in run(monitor.deltas(events, "2 hours"), f"d{name}").collect()}
        assert {k: v for k, v in got.items() if k < 1000} == want


def test_snapshot_survives_retries_and_gaps(spark, tmp_path):
    event = "seq long, ts timestamp, system_id string, layer string, measurement double, uid string"
    row = lambda seq, value: spark.createDataFrame([(seq, None, "s", "hardware", value, "u")], event)
    path = f"{tmp_path}/t"
    assert monitor.latest_snapshot(spark, path).count() == 0
    version = lambda df, n: df.select("system_id", "layer", "seq", "measurement").write.mode("overwrite").parquet(f"{path}/version={n}")
    version(row(1, 1.0), 0)
    version(row(5, 5.0), 3)  # numbers in between were left out
    os.remove(f"{path}/version=3/_SUCCESS")  # and this one never ended
    assert monitor._newest(spark, path) == 0 and monitor._newest(spark, path, 0) is None
    assert [r.seq for r in monitor.latest_snapshot(spark, path).collect()] == [1]


def test_polling_goes_on_after_a_failure():
    seen, waits = [], []

    def collect():
        if len(waits) == 1:
            raise OSError("down")
        return "rows"

    assert monitor.poll(collect, lambda df, k: seen.append((df, k)), 3, 0.2, waits.append) == 2
    assert seen == [("rows", 0), ("rows", 2)] and waits == [1.0, 1.0]


def test_one_collector_fails_alone(spark):
    good = lambda: spark.createDataFrame([("s", "hardware", 1.0)], "system_id string, layer string, measurement double")

    def bad():
        raise OSError("down")

    got = {(r.collector, r.healthy, r.layer) for r in monitor.collect_all({"a": good, "b": bad}, spark).collect()}
    assert got == {("a", True, "hardware"), ("a", True, "health"), ("b", False, "health")}
