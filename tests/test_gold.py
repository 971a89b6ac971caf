import numpy as np
from pyspark.sql import functions as F

from convoy.operators import gold, slo
from convoy.settings import FEATURES


def stats_fixture(spark):
    rows = []
    for device, extra in (("DEVICE_TYPE_SIMULATOR", 0), ("DEVICE_TYPE_VEHICLE", 5)):
        rows += [(device, 20.0 + i + extra, 0.2 + 0.01 * i, 40 + 0.1 * i, 35.0 + i) for i in range(30)]
    rows += [(None, None, float("nan"), 1.0, 2.0)]
    return spark.createDataFrame(rows, "device_type string, " + ", ".join(f"{f} double" for f in FEATURES))


def test_feature_statistics(spark):
    got = {r.device_type: r for r in gold.feature_statistics(stats_fixture(spark)).collect()}
    speed = np.arange(20.0, 50.0)
    sim, vehicle = got["DEVICE_TYPE_SIMULATOR"], got["DEVICE_TYPE_VEHICLE"]
    assert sim.row_count == 30 and vehicle.speed_mph_mean > sim.speed_mph_mean
    assert abs(sim.speed_mph_std - speed.std()) < 1e-9
    assert abs(sim.speed_mph_p95 - np.percentile(speed, 95)) < 1e-9
    none = got["DEVICE_TYPE_UNSPECIFIED"]
    assert none.row_count == 1 and none.speed_mph_mean is None and none.brake_pressure_p50 is None
    assert none.lidar_temp_c_p50 == 1.0


def test_features_as_of_respects_order_and_ttl(spark):
    stats = spark.createDataFrame(
        [("A", "2024-01-02", 1), ("A", "2024-01-04", 2), ("B", "2024-01-01", 3)],
        "device_type string, c string, row_count long",
    ).select("device_type", F.col("c").cast("timestamp").alias("computed_at"), "row_count")
    cases = [
        ("A", "2024-01-01 23:59:59", None),
        ("A", "2024-01-02 00:00:00", 1),
        ("A", "2024-01-03 23:00:00", 1),
        ("A", "2024-01-04 00:00:00", 2),
        ("A", "2024-01-11 00:00:00", 2),
        ("A", "2024-01-11 00:00:01", None),
        ("B", "2024-01-05 10:00:00", 3),
        ("C", "2024-01-05 10:00:00", None),
    ]
    events = spark.createDataFrame(
        [(i, d, t) for i, (d, t, _) in enumerate(cases)], "event_id long, device_type string, t string"
    ).withColumn("event_time", F.col("t").cast("timestamp"))
    want = [w for *_, w in cases]
    got = gold.features_as_of(events, stats).orderBy("event_id").collect()
    assert [r.row_count for r in got] == want


def test_quarantine_audit(spark):
    rows = [("r1", "f", "VH-0000001", "t"), ("r1", "f", "VH-0000001", None), ("r2", "g", None, "t")]
    df = spark.createDataFrame(rows, "reason string, field string, vehicle_id string, source_topic string")
    got = {(r.dimension, r.key): r["count"] for r in gold.quarantine_audit(df, 1).collect()}
    assert got == {
        ("reason", "r1"): 2,
        ("field", "f"): 2,
        ("vehicle_id", "VH-0000001"): 2,
        ("source_topic", "t"): 2,
        ("source_topic", "unknown"): 1,
        ("total", "all"): 3,
    }
    plan = gold.quarantine_audit(df, 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_lifetime_ratio_of_nothing_is_one(spark):
    empty = spark.createDataFrame([], "route string")
    assert gold.lifetime_pass_ratio(empty).first().pass_ratio == 1.0


def test_sustained_alerts_need_the_whole_hold(spark):
    rows = [("qa_pass_ratio", s, v) for s, v in [(0, 0.5), (60, 0.5), (120, 0.9), (180, 1.0), (240, 0.5), (300, 0.5)]]
    rows += [("breakers_open", s, v) for s, v in [(0, 0.0), (60, 1.0), (120, 2.0), (180, 0.0)]]
    df = spark.createDataFrame(rows, "m string, s long, value double").withColumn("at", F.timestamp_seconds("s"))
    parts = [slo.samples(m, df.where(F.col("m") == m), "at", "value") for m in ("qa_pass_ratio", "breakers_open")]
    got = slo.sustained_alerts(parts[0].unionByName(parts[1])).orderBy("alert").collect()
    assert [(r.alert, r.severity, r.samples, r.value) for r in got] == [
        ("CircuitBreakerOpen", "critical", 2, 2.0),
        ("QAPassRateSLOBreach", "warning", 3, 0.9),
    ]


def test_report_lines(spark):
    df = spark.createDataFrame(
        [("qa_pass_ratio", 0.5), ("drift_score_avg", 0.1), ("breakers_open", 2.0), ("breaker_trip_rate", 0.0)],
        "metric string, value double",
    )
    got = sorted(r.line for r in slo.report(df).collect())
    assert got == ["2 circuit breaker(s) OPEN", "QA pass ratio 0.5000 below 0.99 SLO"]
    calm = slo.report(df.where("metric = 'drift_score_avg'")).collect()
    assert [(r.status, r.metric) for r in calm] == [("CLEAR", "all")]


def test_bucket_quantiles_stay_in_the_bucket_of_the_exact_ones(spark):
    import bisect
    import random

    from pyspark.sql import functions as F

    from convoy.operators import slo

    rng = random.Random(8)
    rows = [(k, i % 4, rng.lognormvariate(-2 + k, 1.5)) for k in range(4) for i in range(400)] + [(9, 0, None), (9, 0, 3.0)]
    df = spark.createDataFrame(rows, "k int, part int, seconds double")
    whole = slo.histogram(df, "seconds", ["k"])
    parts = slo.merged(slo.histogram(df, "seconds", ["k", "part"]), ["k"])
    assert whole.exceptAll(parts).count() == 0
    got = {r.k: r for r in whole.select("k", "total", slo.bucket_quantile(0.5).alias("p50"), slo.bucket_quantile(0.95).alias("p95")).collect()}
    assert got[9].total == 1 and 2.5 <= got[9].p50 <= 5.0
    bounds = (0.0, *slo.LATENCY_BOUNDS)
    for k in range(4):
        values = sorted(v for key, _, v in rows if key == k)
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            exact = values[-(-int(p * 1000) * len(values) // 1000) - 1]
            at = bisect.bisect_left(slo.LATENCY_BOUNDS, exact)
            if at == len(slo.LATENCY_BOUNDS):
                assert got[k][name] == slo.LATENCY_BOUNDS[-1]
            else:
                assert bounds[at] <= got[k][name] <= bounds[at + 1]
    lowest = df.where("k = 0").withColumn("seconds", F.lit(0.001))
    assert slo.histogram(lowest, "seconds", ["k"]).select(slo.bucket_quantile(0.5)).first()[0] == 0.0025
