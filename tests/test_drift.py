import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.functions import kstest
from convoy.operators import drift, retrain, windows
from convoy.settings import FEATURE_SCALE, FEATURES, DriftSettings, RetrainSettings


def ks(a, b):
    points = np.concatenate([a, b])
    fa = np.searchsorted(np.sort(a), points, "right") / len(a)
    fb = np.searchsorted(np.sort(b), points, "right") / len(b)
    return float(np.abs(fa - fb).max())


def test_critical_values():
    assert kstest.critical_statistic(50, 200, 0.05) == 0.215
    assert kstest.critical_statistic(20, 50, 0.05) == 0.35
    assert kstest.critical_statistic(80, 400, 0.05) == 0.165
    assert abs(kstest.exact_p_value(50, 200, 43 / 200) - 0.04498) < 1e-5
    assert abs(kstest.exact_p_value(50, 200, 42 / 200) - 0.05353) < 1e-5


def test_exact_and_limiting_agree_on_large_samples():
    assert abs(kstest.exact_p_value(900, 1000, 0.06) - kstest.limiting_p_value(900, 1000, 0.06)) < 0.01
    assert kstest.p_value(20_000, 30_000, 0.0, kstest.LIMITING) == 1.0
    with pytest.raises(ValueError):
        kstest.p_value(5, 5, 0.2, "auto")
    # Literal p-values of small samples, by counting orderings.
    assert abs(kstest.p_value(3, 3, 1.0) - 0.1) < 1e-12
    assert abs(kstest.p_value(4, 4, 1.0) - 2 / 70) < 1e-12
    got = kstest.exact_p_values(3, 3, np.array([[1.0, 1.0], [1 / 3, 2 / 3]]))
    assert np.allclose(got, [[0.1, 0.1], [1.0, 0.6]])


def test_exact_p_value_by_enumeration():
    from itertools import combinations

    n, m = 3, 4
    stats = []
    for chosen in combinations(range(n + m), n):
        a = np.array(chosen, float)
        b = np.array([i for i in range(n + m) if i not in chosen], float)
        stats.append(ks(a, b))
    for d in sorted(set(stats)):
        want = np.mean([s >= d - 1e-12 for s in stats])
        assert abs(kstest.exact_p_value(n, m, d) - want) < 1e-9


@pytest.mark.parametrize("shift, drifts", [(3.0, True), (0.0, False)])
def test_two_sample_over_tables(spark, shift, drifts):
    rng = np.random.default_rng(4)
    a, b = rng.normal(shift, 1, 500).round(1), rng.normal(0, 1, 400).round(1)
    rows = [("x", float(v), True) for v in a] + [("x", float(v), False) for v in b]
    rows += [("empty", 1.0, True)]
    df = spark.createDataFrame(rows, "feature string, value double, current boolean")
    got = drift.two_sample(df, ["feature"], "value", "current").collect()
    assert len(got) == 1 and abs(got[0].ks_statistic - ks(a, b)) < 1e-12
    assert got[0].drift_detected is drifts and (got[0].n_current, got[0].n_reference) == (500, 400)


def telemetry(rng, n):
    cols = {f: rng.normal(m, s, n) for f, (m, s) in FEATURE_SCALE.items()}
    cols["speed_mph"] = np.clip(cols["speed_mph"], 0, 120).round(0)
    return np.column_stack([cols[f] for f in FEATURES])


def frame(spark, x):
    rows = [(i, i, *map(float, r)) for i, r in enumerate(x)]
    ddl = "s long, event_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, ddl).withColumn("event_time", F.timestamp_seconds("s")).drop("s")


SMALL = DriftSettings(warmup=20, baseline=40, window=10)


@pytest.mark.parametrize("stride", [1, 3, 10])
def test_sliding_windows_match_brute_force(spark, monkeypatch, stride):
    monkeypatch.setattr(drift, "BLOCK", 37)
    cfg = DriftSettings(warmup=20, baseline=40, window=10, stride=stride)
    x = telemetry(np.random.default_rng(9), 200)
    x[120:, 0] += 40
    got = drift.windows(windows.drift_sequence(frame(spark, x), cfg), cfg).orderBy("window_no").collect()
    z = (x - [FEATURE_SCALE[f][0] for f in FEATURES]) / [FEATURE_SCALE[f][1] for f in FEATURES]
    full = np.column_stack([x, np.linalg.norm(z, axis=1)])
    base, before = full[20:60], False
    starts = range(60, 200 - 10 + 1, stride)
    assert [r.window_no for r in got] == list(range(len(starts)))
    for r, at in zip(got, starts):
        stats = [ks(full[at : at + 10, i], base[:, i]) for i in range(5)]
        assert np.allclose([r[f"{n}_score"] for n in drift.SCORED], stats)
        flags = [kstest.exact_p_value(10, 40, d) < 0.05 for d in stats]
        assert r.drifted_features == [n for n, hit in zip(drift.SCORED, flags) if hit]
        assert r.last_event == at + 9
        centre = z[at : at + 10].mean(0) - z[20:60].mean(0)
        assert abs(r.euclidean_distance - np.linalg.norm(centre)) < 1e-9
        assert r.breached == (sum(flags) >= 2) and r.rising == (r.breached and not before)
        before = r.breached


def test_no_analysis_before_the_baseline_is_full(spark):
    x = telemetry(np.random.default_rng(1), 45)
    assert drift.windows(windows.drift_sequence(frame(spark, x), SMALL), SMALL).count() == 0


def test_incident_rate_without_shift_and_detection_with_one(spark):
    rng = np.random.default_rng(12)
    calm = drift.windows(windows.drift_sequence(frame(spark, telemetry(rng, 900))))
    total = calm.count()
    assert total == 900 - 400 - 49 and drift.incidents(calm).count() < 0.1 * total
    x = telemetry(rng, 900)
    x[650:, 0] += 45
    x[650:, 2] += 20
    found = drift.incidents(drift.windows(windows.drift_sequence(frame(spark, x)))).collect()
    assert any("speed_mph" in r.drifted_features and r.observed_value >= 2 for r in found)


def test_centroids(spark):
    x = telemetry(np.random.default_rng(3), 200)
    same = drift.centroid_metrics(frame(spark, x), frame(spark, x)).first()
    assert same.mean_euclidean_distance < 1e-9 and not same.drift_detected
    moved = drift.centroid_metrics(frame(spark, x + 10), frame(spark, x)).first()
    assert moved.mean_euclidean_distance > 2 and moved.drift_detected
    empty = drift.centroid_metrics(frame(spark, x).limit(0), frame(spark, x)).first()
    assert (empty.mean_cosine_similarity, empty.mean_euclidean_distance) == (1.0, 0.0)


def signal(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "s long, source_report string, window_size int, feature_scores map<string,double>,"
        " drifted_feature_count int, max_drift_score double",
    ).withColumn("generated_at", F.timestamp_seconds("s"))


def test_retrain_reasons(spark):
    scores = {"speed_mph": 0.8, "brake_pressure": 0.7, "lidar_temp_c": 0.1, "compute_load_pct": 0.2}
    df = signal(
        spark,
        (1, "a", 50, scores, 2, 0.8),
        (2, "b", 50, {"x": 0.1}, 0, 0.1),
        (3, "c", 50, {"x": 0.6}, 1, 0.6),
        (4, "d", 50, {"x": 0.1, "y": 0.1}, None, None),
    )
    got = [(r.should_retrain, r.reason) for r in retrain.decide(df).orderBy("s").collect()]
    assert got == [
        (True, "score_and_feature_count"),
        (False, "below_threshold"),
        (True, "max_drift_score"),
        (True, "drifted_feature_count"),
    ]
    assert retrain.decide_latest(df).first().source_report == "d"
    none = retrain.decide_latest(df.limit(0), RetrainSettings()).first()
    assert (none.should_retrain, none.reason, none.window_size) == (False, "no_evidently_signal", 0)
    assert retrain.runs(retrain.decide(df)).count() == 3


def test_signals_count_scores_or_flags(spark):
    x = telemetry(np.random.default_rng(6), 110)
    scored = drift.windows(windows.drift_sequence(frame(spark, x), SMALL), SMALL)
    plain = drift.signals(scored, F.lit(True), 10).orderBy("generated_at").collect()
    flagged = drift.signals(scored, F.lit(True), 10, count_flagged=True).orderBy("generated_at").collect()
    counts = [r.drifted_count for r in scored.orderBy("window_no").collect()]
    assert [r.drifted_feature_count for r in flagged] == counts
    for r in plain:
        assert r.drifted_feature_count == sum(v > 0 for v in r.feature_scores.values())
        assert r.max_drift_score == max(r.feature_scores.values())


def test_every_nth_and_retention(spark):
    df = spark.range(1, 4501).select(F.col("id").alias("n"))
    hits = [r.n for r in df.where(windows.every_nth(F.col("n"))).orderBy("n").collect()]
    assert hits == [1500, 3000, 4500]
    kept = windows.split_retention(df, [F.col("n")], 48).where("not expired")
    assert kept.count() == 48 and kept.agg(F.min("n")).first()[0] == 4453
    assert windows.split_retention(df, [F.col("n")], 0).where("expired").count() == 0


def test_staleness(spark):
    x = telemetry(np.random.default_rng(1), 70)
    got = windows.baseline_staleness(windows.drift_sequence(frame(spark, x), SMALL)).orderBy("seq").collect()
    assert got[59].staleness_seconds == 0.0 and got[69].staleness_seconds == 10.0
    assert math.isclose(got[60].staleness_seconds, 1.0)
