import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from convoy import session
from convoy.operators import contracts, frames, gold
from convoy.operators import normalize as norm
from convoy.plans import queries as q
from convoy.settings import FEATURES
from convoy.sources import lake, messages, tables
from convoy.streaming import jobs


def test_partitions_and_pruning(spark, sf):
    path = session.new_dir(spark, "lake")
    rows = lake.telemetry_rows(q.validated(spark, sf))
    lake.append_telemetry(rows, path)
    assert {d.split("=")[0] for d in os.listdir(path) if "=" in d} == {"device_type"}
    back = lake.load(spark, path)
    assert back.count() == rows.count()
    plan = gold.day_count(back, "2024-01-15")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan
    recent = gold.device_recent(back, "DEVICE_TYPE_SIMULATOR")
    plan = recent._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "DEVICE_TYPE_SIMULATOR" in plan.split("PartitionFilters")[1]


def test_rows_missing_a_field_are_counted_not_written(spark, sf):
    raw = tables.telemetry(spark, sf).withColumn("trip_id", F.when(F.col("event_id") > 9, F.col("trip_id")))
    counters = lake.map_counters(lake.telemetry_rows(raw)).first()
    assert counters.consumed == 1000 and counters.appended + counters.map_errors == 1000
    assert counters.map_errors >= 10


def test_epoch_and_text_timestamps_map_alike(spark):
    base = {f: 1.0 for f in ("gps_lat", "gps_lon", *FEATURES)}
    texts = {f: "x" for f in ("vehicle_id", "trip_id", "sensor_status", "hardware_version", "device_type")}
    rows = [{**base, **texts, "timestamp": t} for t in ("1721671200", "1721671200000", "2024-07-22T18:00:00Z")]
    df = spark.createDataFrame(rows)
    got = lake.telemetry_rows(df).select(F.col("timestamp").cast("string"), "event_day").distinct().collect()
    assert len(got) == 1 and got[0][0] == "2024-07-22 18:00:00"


def test_commit_replay_and_snapshot(spark):
    path = session.new_dir(spark, "commits")
    df = spark.range(5)
    lake.commit(df, path, 1)
    lake.commit(df.where("id < 2"), path, 2)
    lake.commit(df.where("id < 3"), path, 2)
    assert lake.as_of(spark, path, 1).count() == 5 and lake.as_of(spark, path, 2).count() == 8


def test_csv_fixture_override(spark):
    path = session.new_dir(spark, "fixture") + ".csv"
    spark.createDataFrame([("VH-0001", 1.5)], "vehicle_id string, speed_mph double").write.option("header", True).csv(path)
    assert lake.load(spark, "unused", fixture=path).first().speed_mph == 1.5
    # The telemetry table's types are the default; a schema of one's own leaves other columns as text.
    assert lake.load(spark, "unused", fixture=path, schema="vehicle_id string").first().speed_mph == "1.5"


def test_frame_tables(spark):
    from tests.test_frames_search import world

    physical = frames.physics(world(spark))
    path = session.new_dir(spark, "truth")
    lake.append_frames(frames.ground_truth_rows(physical), path)
    back = lake.load(spark, path)
    assert back.count() == 8 and dict(back.dtypes)["frame_idx"] == "double"
    assert json.loads(back.first().agents_json)[0]["role"] == "ego"


def split_events(spark, sf, days=("2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01")):
    """The events as time-ordered files, one per stretch of days."""
    events, path = tables.table(spark, sf, "events"), session.new_dir(spark, "events")
    for low, high in zip(days, days[1:]):
        part = events.where((F.col("ts") >= low) & (F.col("ts") < high))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events, stream


def test_message_stream_to_topics(spark):
    root = session.new_dir(spark, "messages")
    good = {
        "vehicle_id": "VH-0001", "trip_id": "t", "timestamp": "2026-07-22T18:00:00Z", "gps_lat": 1, "gps_lon": 2,
        "speed_mph": 3, "brake_pressure": 0.1, "lidar_temp_c": 4, "compute_load_pct": 5,
        "sensor_status": "SENSOR_STATUS_OK", "hardware_version": "h", "device_type": "DEVICE_TYPE_VEHICLE",
    }
    lines = [good, {**good, "speed_mph": "fast"}, {**good, "vehicle_id": ""}, {**good, "gps_lat": 999}]
    values = [json.dumps(r) for r in lines] + ["{broken"]
    spark.createDataFrame([(v,) for v in values], "value string").write.text(f"{root}/in")
    raw = messages.decode(messages.file_stream(spark, f"{root}/in"))
    jobs.drain(jobs.normalize_stream(raw, F.current_timestamp(), f"{root}/n", f"{root}/c1"))
    bad = spark.read.parquet(f"{root}/n/quarantine")
    assert sorted(r.rule for r in bad.collect()) == ["decode", "required_nonempty", "type:float"]
    good_rows = spark.read.parquet(f"{root}/n/normalized")
    again = spark.readStream.schema(good_rows.schema).parquet(f"{root}/n/normalized")
    jobs.drain(jobs.gate_stream(again, F.current_timestamp(), f"{root}/g", f"{root}/c2"))
    assert spark.read.parquet(f"{root}/g/validated").count() == 1
    assert [r.rule for r in spark.read.parquet(f"{root}/g/quarantine").collect()] == ["in_range[-90.0,90.0]"]
    counts = {r.route: r.records for r in spark.read.parquet(f"{root}/g/counters").collect()}
    assert counts == {"validated": 1, "quarantine": 1}


def test_windowed_ratio_stream_counts_every_record(spark, sf):
    events, stream = split_events(spark, sf)
    root = session.new_dir(spark, "ratio")
    gated = contracts.gate(norm.accepted(norm.normalize(tables.telemetry_of(stream))))
    jobs.drain(jobs.pass_ratio_stream(gated, f"{root}/r", f"{root}/c", "6 hours"))
    assert spark.read.parquet(f"{root}/r").select("batch_id").distinct().count() >= 3
    want = (
        contracts.gate(norm.accepted(norm.normalize(tables.telemetry_of(events))))
        .groupBy(F.window("event_time", "6 hours").start.alias("window_start"))
        .agg(F.count_if(F.expr("route = 'validated'")).alias("validated"), F.count_if(F.expr("route = 'quarantine'")).alias("quarantined"))
    )
    got = jobs.pass_ratio(spark, f"{root}/r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_sink_is_seen_before_all_hold_the_batch(spark, sf, monkeypatch):
    events, stream = split_events(spark, sf)
    root = session.new_dir(spark, "atomic")
    rows = norm.accepted(norm.normalize(tables.telemetry_of(stream)))
    real = jobs._write

    def failing(df, path, batch_id, by=None):
        if batch_id == 1 and path.endswith("quarantine"):
            raise RuntimeError("killed between two sinks")
        real(df, path, batch_id, by)

    monkeypatch.setattr(jobs, "_write", failing)
    with pytest.raises(StreamingQueryException):
        jobs.drain(jobs.gate_stream(rows, F.col("event_ts"), f"{root}/g", f"{root}/c"))
    assert spark.read.parquet(f"{root}/g/validated").where("batch_id = 1").count() > 0
    seen = {n: jobs.committed(spark, f"{root}/g", n).select("batch_id").distinct().collect() for n in ("validated", "quarantine")}
    assert all([r.batch_id for r in v] == [0] for v in seen.values())
    monkeypatch.setattr(jobs, "_write", real)
    jobs.drain(jobs.gate_stream(rows, F.col("event_ts"), f"{root}/g", f"{root}/c"))
    want = contracts.gate(norm.accepted(norm.normalize(tables.telemetry_of(events))))
    for route, name in (("validated", "validated"), ("quarantine", "quarantine")):
        assert jobs.committed(spark, f"{root}/g", name).count() == want.where(F.col("route") == route).count()
    # Counters come from the rows on their way, batch by batch.
    counted = jobs.committed(spark, f"{root}/g", "counters").groupBy("route").agg(F.sum("records").alias("n")).collect()
    assert {r.route: r.n for r in counted} == {r.route: r["count"] for r in want.groupBy("route").count().collect()}


def test_a_repeat_without_rows_leaves_nothing_published(spark):
    path = session.new_dir(spark, "publish")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    lake.publish_batch(rows, path, "2024-01-01", "one")
    lake.publish_batch(rows.limit(1), path, "2024-01-01", "two")
    lake.publish_batch(rows.where("false"), path, "2024-01-01", "one")
    assert [r.execution_id for r in spark.read.parquet(path).select("execution_id").collect()] == ["two"]


def test_a_running_commit_is_not_seen(spark):
    path = session.new_dir(spark, "commit-marks")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    lake.commit(rows, path, 1)
    lake.commit(rows, path, 2)
    assert lake.as_of(spark, path, 2).count() == 4 and lake.as_of(spark, path, 1).count() == 2
    # Files of a third commit lie there, its mark does not.
    rows.withColumn("commit_id", F.lit(3)).write.mode("append").partitionBy("commit_id").parquet(path)
    assert lake.as_of(spark, path, 9).count() == 4
    lake.commit(rows.limit(1), path, 3)
    assert lake.as_of(spark, path, 9).count() == 5
    lake.commit(rows.where("false"), path, 2)
    assert sorted(r.commit_id for r in lake.as_of(spark, path, 9).select("commit_id").distinct().collect()) == [1, 3]
