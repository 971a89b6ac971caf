"""Streams over several shuffled micro-batches against the batch job on the same rows."""

import json
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy import session
from convoy.operators import breaker, drift, episodes, windows
from convoy.operators.breaker import ORDER
from convoy.plans import queries as q
from convoy.settings import FEATURES, BreakerSettings, DriftSettings, QaSettings
from convoy.sources import message_log
from convoy.streaming import changelog, drift_stream, jobs, stateful

START = datetime(2024, 1, 1, tzinfo=UTC)
CFG = BreakerSettings(cooldown_seconds=3 * 3600.0, half_open_successes=2)


@pytest.fixture(scope="module")
def rows(spark):
    """Outcomes of vehicles over six days; one vehicle has a third of them, and instants tie."""
    rng = random.Random(4)
    made = []
    for i in range(3_000):
        vehicle = "VH-HOT" if i % 3 == 0 else f"VH-{rng.randrange(12):04d}"
        at = START + timedelta(minutes=rng.randrange(6 * 24 * 60 // 5) * 5)
        made.append((i, vehicle, at, rng.random() < (0.4 if at.day % 2 else 0.05)))
    return spark.createDataFrame(made, "event_id long, vehicle_id string, event_time timestamp, bad boolean")


@pytest.fixture(scope="module")
def reports(spark):
    rng = random.Random(6)
    made = []
    for i in range(400):
        vehicle = "VH-HOT" if i % 3 == 0 else f"VH-{rng.randrange(12):04d}"
        made.append((f"drift-{i}", vehicle, START + timedelta(seconds=rng.randrange(6 * 86_400)), float(rng.randrange(4)), None))
    return spark.createDataFrame(
        made, "incident_id string, vehicle_id string, event_time timestamp, observed_value double, drifted_features array<string>"
    )


def with_data(query):
    return sum(p["numInputRows"] > 1 for p in query.recentProgress)


def run_windows(spark, rows, root, writer=jobs.table_stream):
    log = f"{root}/log"
    q._to_log(rows, "event_time", "event_id", log)
    back = q._from_log(spark, rows.schema, log)
    closed = stateful.count_windows(back, clock="sent_at")
    return jobs.drain_log(writer(closed, f"{root}/out", f"{root}/check"), lambda: q._clock_on(spark, log))


def run_breaker(spark, rows, reports, root, writer):
    stateful.use_state_store(spark)
    closed = windows.count_windows(rows).withColumn("name", F.concat_ws("/", "vehicle_id", "window_no"))
    for name, table, at, key in (("qa", closed, "window_end", "name"), ("drift", reports, "event_time", "incident_id")):
        q._to_log(table, at, key, f"{root}/{name}")
    states = stateful.correlate(
        q._from_log(spark, closed.schema, f"{root}/qa").drop("window_end").withColumnRenamed("sent_at", "window_end"),
        q._from_log(spark, reports.schema, f"{root}/drift").drop("event_time").withColumnRenamed("sent_at", "event_time"),
        cfg=CFG,
    )
    return jobs.drain_log(writer(states), lambda: [q._clock_on(spark, f"{root}/{n}") for n in ("qa", "drift")])


def batch_states(rows, reports):
    return breaker.evaluate(windows.rolling_quality(windows.count_windows(rows)), reports, cfg=CFG)


def test_windows_of_late_records(spark, rows):
    stateful.use_state_store(spark)
    root = session.new_dir(spark, "late")
    query = run_windows(spark, rows, root)
    assert with_data(query) >= 3
    got = spark.read.parquet(f"{root}/out")
    want = windows.count_windows(rows).select(got.columns)
    assert got.count() == want.count() > 100
    assert want.exceptAll(got).count() == 0
    # The log gives its records out of the order in which they were sent.
    sent = [r.sent_at for r in spark.read.parquet(f"{root}/log").where("partition = 0 and value is not null").orderBy("offset").collect()]
    assert sent != sorted(sent)


def test_breaker_episodes_and_live_state(spark, rows, reports):
    root = session.new_dir(spark, "breaker")
    path = f"{root}/states"
    query = run_breaker(spark, rows, reports, root, lambda s: jobs.table_stream(s, path, f"{root}/check"))
    assert with_data(query) >= 3
    want = batch_states(rows, reports)
    cols = ["vehicle_id", "event_time", "ref", "prior_state", "state", "tripped", "recovered", "trip_count", "route",
            "rolling_rate", "batch_count", "streak"]
    got = spark.read.parquet(path)
    assert got.count() == want.count()
    rounded = [F.round(c, 9).alias(c) if c == "rolling_rate" else c for c in cols]
    assert want.select(rounded).exceptAll(got.select(rounded)).count() == 0
    assert got.where("recovered").count() > 3

    # Episodes from the transitions' versions, as the batch job finds them from all states.
    log = f"{root}/episodes"
    versions = episodes.versions(got)
    for n in range(4):
        changelog.append(versions.where(F.pmod(F.xxhash64("ref"), F.lit(4)) == n), log, n)
    changelog.append(versions.where(F.pmod(F.xxhash64("ref"), F.lit(4)) == 2), log, 2)
    expected = episodes.episodes(want)
    show = [F.round(c, 9).alias(c) if c == "rolling_rate" else F.col(c) for c in expected.columns]

    def table():
        return changelog.read(spark, log, episodes.EPISODE_ROW, "incident_id", ORDER).select(show)

    for _ in range(3):
        back = table()
        assert back.count() == expected.count()
        assert expected.select(show).exceptAll(back).count() == 0
        changelog.compact(spark, log, episodes.EPISODE_ROW, "incident_id", ORDER)
        if _ == 1:
            changelog.append(versions.where("false"), log, 4)

    # The breakers as the state has them, and as the batch has them at the same instant.
    for at in ("2024-01-07 00:00:00", "2024-01-20 00:00:00"):
        moment = F.lit(at).cast("timestamp")
        live = stateful.live_breakers(spark, f"{root}/check", moment, CFG)
        frozen = breaker.snapshot(want, moment, CFG)
        assert live.count() == frozen.count() == 13
        assert frozen.select(live.columns).exceptAll(live).count() == 0


def test_episode_stream(spark, rows, reports):
    root = session.new_dir(spark, "episode-stream")
    run_breaker(spark, rows, reports, root, lambda s: jobs.episode_stream(s, f"{root}/out", f"{root}/check", compact_every=2))
    got, want = jobs.episodes_so_far(spark, f"{root}/out"), episodes.episodes(batch_states(rows, reports))
    cols = ["incident_id", "vehicle_id", "status", "first_trip", "last_trip", "resolved_at", "retrip_count", "route", "summary"]
    assert got.count() == want.count() > 10
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
    assert any("upto=" in p for p in session.children(spark, f"{root}/out/snapshots"))


def test_log_is_read_by_offsets_and_restarts(spark):
    root = session.new_dir(spark, "log")
    made = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 60).alias("sent_at"), F.concat(F.lit("v"), "id").alias("value"), "id"
    )
    message_log.append(made, f"{root}/log", F.col("id") % 5, ["id"], partitions=3, segment=40)
    assert sum(message_log.ends(f"{root}/log").values()) == 500

    def run(per_trigger):
        stream = message_log.stream(spark, f"{root}/log", per_trigger, f"{root}/place")
        query = jobs.drain_log(jobs.table_stream(stream, f"{root}/out", f"{root}/check"))
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    sizes = run(130)
    assert len(sizes) == 4 and max(sizes) <= 133 and sum(sizes) == 500
    later = made.withColumns({"value": F.concat(F.lit("w"), "id"), "id": F.col("id") + 500}).limit(90)
    message_log.append(later, f"{root}/log", F.col("id") % 5, ["id"], partitions=3, segment=40)
    assert sum(run(50)) == 90
    back = spark.read.parquet(f"{root}/out")
    assert back.count() == back.select("partition", "offset").distinct().count() == 590
    assert back.select("value").distinct().count() == 590
    assert run(50) == []
    # A record is named by its place.
    assert back.where("value = 'v0'").select("partition").first().partition in (0, 1, 2)
    for r in back.groupBy("partition").agg(F.max("offset").alias("last"), F.count("*").alias("n")).collect():
        assert r.last + 1 == r.n


def test_a_gap_hides_what_follows():
    segments = [message_log.Segment(0, 5, "a"), message_log.Segment(5, 9, "b"), message_log.Segment(12, 20, "c")]
    assert message_log._without_gaps(segments) == segments[:2]
    assert message_log._without_gaps(segments[1:]) == []


def test_place_is_kept_before_it_is_told(tmp_path):
    reader = message_log.LogReader(str(tmp_path / "none"), 5, str(tmp_path / "place"))
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    reader._keep({"0": 7})
    again = message_log.LogReader(str(tmp_path / "none"), 5, str(tmp_path / "place"))
    assert again.latestOffset() == {"0": 7}
    assert json.loads((tmp_path / "place" / "handed-out.json").read_text()) == {"0": 7}


def test_rolling_and_streaks_over_pieces():
    rng = np.random.default_rng(2)
    rates, exceeded = rng.random(50), rng.random(50) < 0.6
    means, streaks = [], []
    run = 0
    for i in range(50):
        last = rates[max(0, i - 4) : i + 1]
        means.append(sum(last.tolist()) / len(last))
        run = run + 1 if exceeded[i] else 0
        streaks.append(run)
    known, streak, got_means, got_streaks = [], 0, [], []
    for piece in np.array_split(np.arange(50), [3, 4, 17, 17, 40]):
        if len(piece):
            mean, _ = stateful._rolled(known, rates[piece], 5)
            runs = stateful._streaks(streak, exceeded[piece])
            known, streak = [*known, *rates[piece].tolist()][-5:], int(runs[-1])
            got_means += mean.tolist()
            got_streaks += runs.tolist()
    assert got_means == pytest.approx(means) and got_streaks == streaks


@pytest.mark.parametrize("text_ids", [False, True])
def test_drift_windows_of_late_records(spark, text_ids, monkeypatch):
    rng = random.Random(3)
    made = []
    for i in range(900):
        at = START + timedelta(minutes=rng.randrange(5 * 24 * 60 // 10) * 10)
        late = at > START + timedelta(days=3)
        made.append((f"r{i:04d}" if text_ids else i, at, *[rng.gauss(30.0 * late * (f % 2), 5.0) for f in range(4)]))
    kind = "string" if text_ids else "long"
    rows = spark.createDataFrame(made, f"event_id {kind}, event_time timestamp, " + ", ".join(f"{f} double" for f in FEATURES))
    small = DriftSettings(warmup=30, baseline=60, window=12, stride=3)
    monkeypatch.setattr(drift_stream, "BLOCK", 50)
    stateful.use_state_store(spark)
    root = session.new_dir(spark, "drift")
    q._to_log(rows, "event_time", "event_id", f"{root}/log")
    back = q._from_log(spark, rows.schema, f"{root}/log")
    scored = drift_stream.windows(back, small, clock="sent_at", width_seconds=7200)
    query = jobs.drain_log(jobs.table_stream(scored, f"{root}/out", f"{root}/check"), lambda: q._clock_on(spark, f"{root}/log"))
    assert with_data(query) >= 3
    got = q._window_rows(spark.read.parquet(f"{root}/out"))
    want = q._window_rows(drift.windows(windows.drift_sequence(rows, small), small))
    assert got.count() == want.count() == (900 - 90 - 12) // 3 + 1
    assert want.exceptAll(got).count() == 0
    assert got.where("rising").count() > 0


def test_state_entries_do_not_grow_with_vehicles(spark):
    made = [(i, f"VH-{i % 700:04d}" if i % 700 else None, START + timedelta(minutes=i), i % 3 == 0) for i in range(4_200)]
    rows = spark.createDataFrame(made, "event_id long, vehicle_id string, event_time timestamp, bad boolean")
    stateful.use_state_store(spark)
    root, qa = session.new_dir(spark, "many"), QaSettings(window_size=4)
    q._to_log(rows, "event_time", "event_id", f"{root}/log")
    closed = stateful.count_windows(q._from_log(spark, rows.schema, f"{root}/log"), qa, 10 * 86_400, "sent_at")
    query = jobs.drain_log(jobs.table_stream(closed, f"{root}/out", f"{root}/check"), lambda: q._clock_on(spark, f"{root}/log"))
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    # An entry and its timer for every shard in the one range there is, whatever the number of vehicles.
    assert 0 < max(held) <= 2 * 256
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == 700
    assert windows.count_windows(rows, qa).select(got.columns).exceptAll(got).count() == 0
