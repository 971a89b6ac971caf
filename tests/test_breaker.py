import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoy.functions import policy as rules
from convoy.operators import breaker, episodes, scan, windows
from convoy.operators.breaker import CLOSED, HALF_OPEN, OPEN, Breaker
from convoy.settings import BreakerSettings, PolicySettings, QaSettings

SECOND = 1_000_000


def test_transition_table_of_direct_calls():
    cfg = BreakerSettings(cooldown_seconds=10, probe_on_advance=False)
    rows = [
        (0, False, CLOSED, False, False),
        (0, True, OPEN, True, False),
        (0, True, OPEN, False, False),
        (11, False, HALF_OPEN, False, False),
        (0, True, OPEN, True, False),
        (11, False, HALF_OPEN, False, False),
        (0, False, CLOSED, False, True),
    ]
    state, now = Breaker(), 0
    for advance, trip, kind, tripped, recovered in rows:
        now += advance * SECOND
        out = breaker.step(state, now, trip, cfg)
        assert (out.after.kind, out.tripped, out.recovered) == (kind, tripped, recovered)
        state = out.after


def test_engine_mode_probes_with_the_advancing_call():
    cfg = BreakerSettings(cooldown_seconds=10)
    opened = breaker.step(Breaker(), 0, True, cfg).after
    assert breaker.step(opened, 11 * SECOND, False, cfg).recovered
    assert breaker.step(opened, 11 * SECOND, True, cfg).tripped


def fold(events, cfg, state=Breaker()):
    out = []
    for at, trip in events:
        done = breaker.step(state, at, trip, cfg)
        out.append((state.kind, done.after.kind, done.tripped, done.recovered))
        state = done.after
    return out, state


@hyp(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=1, max_size=60),
    st.integers(1, 3),
    st.booleans(),
    st.integers(1, 12),
)
def test_part_summaries_compose_to_the_fold(gaps, need, probe, size):
    cfg = BreakerSettings(cooldown_seconds=7, half_open_successes=need, probe_on_advance=probe)
    now, events = 0, []
    for gap, trip in gaps:
        now += gap * SECOND
        events.append((now, trip))
    state = Breaker()
    for at in range(0, len(events), size):
        part = events[at : at + size]
        exits = breaker.summarise([t for t, _ in part], [b for _, b in part], cfg)
        _, want = fold(part, cfg, state)
        state = breaker.enter(state, exits, cfg)
        assert state == want


def decisions(spark, n=600):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        vehicle = "hot" if i % 3 == 0 else f"v{rng.randrange(30)}"
        rows.append((vehicle, i * 7 * SECOND, 0, f"{i:06d}", rng.random() < 0.4))
    df = spark.createDataFrame(rows, "vehicle_id string, us long, kind int, ref string, trip boolean")
    return rows, df.withColumn("event_time", F.timestamp_micros("us")).drop("us")


@pytest.mark.parametrize("need, probe", [(1, True), (2, True), (1, False)])
def test_timeline_of_a_hot_vehicle_over_several_parts(spark, need, probe):
    cfg = BreakerSettings(cooldown_seconds=60, half_open_successes=need, probe_on_advance=probe)
    rows, df = decisions(spark)
    tagged = scan.split_in_order(df, ["vehicle_id"], breaker.ORDER, parts=6)
    assert tagged.where("vehicle_id = 'hot'").select(scan.PART).distinct().count() > 1
    got = {}
    for r in breaker.timeline(tagged, cfg).orderBy("vehicle_id", "ref").collect():
        got.setdefault(r.vehicle_id, []).append((r.prior_state, r.state, r.tripped, r.recovered))
    for vehicle in {r[0] for r in rows}:
        want, _ = fold([(r[1], r[4]) for r in rows if r[0] == vehicle], cfg)
        assert got[vehicle] == want


def outcomes(spark, flags, vehicle="VH-0001"):
    rows = [(vehicle, i, i, bool(f)) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "vehicle_id string, s long, event_id long, bad boolean")
    return df.withColumn("event_time", F.timestamp_seconds("s")).drop("s")


def test_count_window_closes_and_partial_never_emits(spark):
    qa = QaSettings(window_size=4)
    out = windows.count_windows(outcomes(spark, [0, 0, 1, 1, 1, 1]), qa).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.total, row.quarantined, row.quarantine_rate, row.exceeded) == (4, 2, 0.5, True)


def test_threshold_is_strict(spark):
    flags = [1, 1, 1] + [0] * 17
    row = windows.count_windows(outcomes(spark, flags)).first()
    assert row.quarantine_rate == 0.15 and row.exceeded is False


def test_rolling_quality_over_small_blocks(spark):
    rng = random.Random(2)
    rates = [rng.choice([0.0, 0.1, 0.2, 0.5]) for _ in range(300)]
    rows = [("hot", i, r, r > 0.15) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "vehicle_id string, window_no long, quarantine_rate double, exceeded boolean")
    got = windows.rolling_quality(df, block=16).orderBy("window_no").collect()
    streak = 0
    for i, r in enumerate(got):
        seen = rates[max(0, i - 4) : i + 1]
        streak = streak + 1 if rates[i] > 0.15 else 0
        assert r.batch_count == len(seen) and r.streak == streak
        assert abs(r.rolling_rate - sum(seen) / len(seen)) < 1e-12
    assert len(got) == 300


POLICY = [
    # rate, batches, streak, drift, hour, day -> trip, route, reason prefix
    (0.20, 5, 0, 0, 10, 27, True, "slack", "qa_quarantine_rate_exceeded: rolling=0.2000 threshold=0.1500 batches=5"),
    (0.99, 2, 0, 0, 10, 27, False, "slack", None),
    (0.0, 5, 0, 2, 10, 27, True, "slack", "multi_feature_drift: count=2 threshold=2"),
    (0.0, 5, 3, 0, 10, 27, True, "slack", "consecutive_qa_failures: count=3 threshold=3"),
    (0.20, 5, 0, 0, 15, 23, True, "pagerduty", "qa_quarantine_rate_exceeded: rolling=0.2000 threshold=0.1500 batches=5"),
    (0.20, 5, 0, 3, 15, 23, True, "both", "multi_feature_drift: count=3 threshold=2"),
    (0.20, 5, 0, 0, 3, 23, True, "slack", "qa_quarantine_rate_exceeded: rolling=0.2000 threshold=0.1500 batches=5"),
]


def test_policy_table(spark):
    # 2024-01-23 is a Tuesday, 2024-01-27 a Saturday.
    rows = [(i, r, b, s, d, f"2024-01-{day} {h:02d}:30:00") for i, (r, b, s, d, h, day, *_) in enumerate(POLICY)]
    df = spark.createDataFrame(
        rows, "i int, rolling_rate double, batch_count long, streak long, drift_count long, t string"
    ).withColumn("event_time", F.col("t").cast("timestamp"))
    got = rules.decide(df, PolicySettings()).orderBy("i").collect()
    for row, (*_, trip, route, reason) in zip(got, POLICY):
        assert (row.trip, row.route) == (trip, route)
        assert row.severity == ("critical" if trip else "warning")
        assert (row.reasons[0] if row.reasons else None) == reason


def run_events(spark, marks, cfg=BreakerSettings(cooldown_seconds=10)):
    """marks: (second, drift count) of one vehicle's drift incidents."""
    rows = [("VH-0001", s, 1, f"{i:04d}", 0.0, 0, 0, d) for i, (s, d) in enumerate(marks)]
    df = spark.createDataFrame(
        rows,
        "vehicle_id string, s long, kind int, ref string, rolling_rate double, batch_count long, streak long, drift_count long",
    ).withColumn("event_time", F.timestamp_seconds("s")).drop("s")
    tagged = scan.split_in_order(df, ["vehicle_id"], breaker.ORDER, parts=2)
    return breaker.timeline(rules.decide(tagged), cfg)


def actions(spark, *rows):
    df = spark.createDataFrame(list(rows), "incident_id string, action string, s long, note string")
    return df.withColumn("action_at", F.timestamp_seconds("s")).drop("s")


def test_retrip_keeps_the_id_and_recovery_resolves(spark):
    table = episodes.episodes(run_events(spark, [(0, 2), (20, 2), (40, 0), (60, 2)]))
    got = table.orderBy("first_trip").collect()
    assert [r.status for r in got] == ["resolved", "open"]
    assert got[0].incident_id == "esc_VH-0001_0000" and got[0].retrip_count == 1
    assert got[0].resolve_reason == "breaker_recovered"
    assert got[0].summary.startswith("Circuit breaker still open for VH-0001 (retrip 1): [multi_feature_drift")
    assert got[1].incident_id == "esc_VH-0001_60000000000" and got[1].retrip_count == 0


def test_manual_resolve_is_idempotent_and_starts_a_new_episode(spark):
    states = run_events(spark, [(5, 2), (20, 2), (40, 2)])
    first = "esc_VH-0001_5000000000"
    log = actions(spark, (first, "resolve", 25, ""), (first, "resolve", 27, ""), ("esc_VH-9_1000", "resolve", 30, ""))
    got = episodes.episodes(states, log).orderBy("first_trip").collect()
    assert [(r.status, r.retrip_count, r.resolve_reason) for r in got] == [("resolved", 1, "manual"), ("open", 0, None)]
    outcomes = {(r.incident_id, r.action_at.second): r.outcome for r in episodes.action_outcomes(
        episodes.episodes(states, log), log).collect()}
    assert outcomes[(first, 25)] == "ok" and outcomes[(first, 27)] == "unchanged"
    assert outcomes[("esc_VH-9_1000", 30)] == "not_found"


def test_acknowledgement_stands_until_a_retrip(spark):
    states = run_events(spark, [(5, 2), (20, 2)])
    first = "esc_VH-0001_5000000000"
    early = episodes.episodes(states, actions(spark, (first, "acknowledge", 10, "on it"))).first()
    assert early.status == "open" and "ack" not in early.summary
    late = episodes.episodes(states, actions(spark, (first, "acknowledge", 30, "on it"))).first()
    assert late.status == "acknowledged" and late.open and late.summary.endswith(" | ack: on it")


def test_one_open_episode_per_vehicle_and_lists(spark):
    rows, df = decisions(spark)
    tagged = scan.split_in_order(
        df.withColumns({c: F.lit(0).cast("long") for c in ("batch_count", "streak")})
        .withColumn("rolling_rate", F.lit(0.0))
        .withColumn("drift_count", F.when(F.col("trip"), 2).otherwise(0).cast("long"))
        .drop("trip"),
        ["vehicle_id"],
        breaker.ORDER,
        parts=5,
    )
    table = episodes.episodes(breaker.timeline(rules.decide(tagged)))
    per = table.where("open").groupBy("vehicle_id").count()
    assert per.where("count > 1").count() == 0
    opened, resolved = episodes.with_status(table, "open"), episodes.with_status(table, "resolved")
    assert opened.count() + resolved.count() == table.count() == episodes.with_status(table).count()
    listed, count = episodes.for_vehicle(table, "HOT")
    assert count.first()["count"] >= listed.count() > 0


def test_snapshot_applies_the_cooldown_when_read(spark):
    states = run_events(spark, [(0, 2)])
    early = breaker.snapshot(states, F.timestamp_seconds(F.lit(5)), BreakerSettings(cooldown_seconds=10)).first()
    late = breaker.snapshot(states, F.timestamp_seconds(F.lit(10)), BreakerSettings(cooldown_seconds=10)).first()
    assert (early.state, early.state_code) == ("open", 2) and (late.state, late.state_code) == ("half_open", 1)


def test_notifications_follow_the_route(spark):
    table = episodes.episodes(run_events(spark, [(0, 2), (20, 2)]))
    both = table.withColumn("route", F.lit("both"))
    got = {r.target: r for r in episodes.notifications(both, "Fleet", "#c", "key").collect()}
    assert got["slack"].slack.text.startswith("[UPDATED x1] :rotating_light: *Fleet Incident* (ongoing)")
    page = got["pagerduty"].pagerduty
    assert page.dedup_key == table.first().incident_id and page.payload.severity == "critical"
    assert page.payload.summary.startswith("[UPDATED x1] Circuit breaker still open")


@pytest.mark.parametrize("probe", [True, False])
@pytest.mark.parametrize("needed", [1, 3])
def test_replay_by_jumps_equals_single_steps(probe, needed):
    rng = np.random.default_rng(needed)
    cfg = BreakerSettings(cooldown_seconds=5e-5, half_open_successes=needed, probe_on_advance=probe)
    for start in (breaker.Breaker(), breaker.Breaker(breaker.OPEN, 10, 0), breaker.Breaker(breaker.HALF_OPEN, 0, 0)):
        times = np.sort(rng.integers(20, 2000, 300))
        trips = rng.uniform(size=300) < 0.1
        got, last = breaker.replay_run(start, times, trips, cfg)
        state = start
        for i in range(300):
            done = breaker.step(state, int(times[i]), bool(trips[i]), cfg)
            codes = breaker.STATE_CODES
            assert (got.prior[i], got.after[i]) == (codes[state.kind], codes[done.after.kind])
            assert (got.tripped[i], got.recovered[i]) == (done.tripped, done.recovered)
            if done.after.kind == breaker.OPEN:
                assert got.opened_us[i] == done.after.opened_us
            state = done.after
        assert last == state
