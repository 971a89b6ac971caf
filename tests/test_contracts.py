import json

import pytest
from pyspark.sql import functions as F

from convoy import settings
from convoy.functions import coerce
from convoy.operators import contracts
from convoy.operators import normalize as norm
from convoy.sources import messages

GOOD = {
    "vehicle_id": "VH-0000001",
    "trip_id": "trip-1",
    "timestamp": "2026-07-22T18:00:00Z",
    "gps_lat": "40.44",
    "gps_lon": "-80.0",
    "speed_mph": "35.0",
    "brake_pressure": "0.1",
    "lidar_temp_c": "40.0",
    "compute_load_pct": "50.0",
    "sensor_status": "SENSOR_STATUS_OK",
    "hardware_version": "hw-rev-3.2",
    "device_type": "DEVICE_TYPE_SIMULATOR",
}
SCHEMA = ", ".join(f"{f} string" for f in settings.TELEMETRY_FIELDS)


def frame(spark, *changes):
    rows = [tuple({**GOOD, **c}[f] for f in settings.TELEMETRY_FIELDS) for c in changes]
    return spark.createDataFrame(rows, SCHEMA)


def broken(df, rules):
    rows = df.select(contracts.violations(rules).alias("v")).collect()
    return [[(v.field, v.rule) for v in r.v] for r in rows]


CASES = [
    ({}, []),
    ({"vehicle_id": "NOPE"}, [("vehicle_id", "regex:^VH-[0-9]{4,8}$")]),
    ({"vehicle_id": None}, [("vehicle_id", "regex:^VH-[0-9]{4,8}$")]),
    ({"vehicle_id": "VH-123456789"}, [("vehicle_id", "regex:^VH-[0-9]{4,8}$")]),
    ({"trip_id": " \t"}, [("trip_id", "required_nonempty")]),
    ({"timestamp": ""}, [("timestamp", "required")]),
    ({"timestamp": None}, [("timestamp", "required")]),
    ({"timestamp": "NOT-A-DATE"}, [("timestamp", "iso8601")]),
    ({"timestamp": "2026"}, [("timestamp", "iso8601")]),
    ({"timestamp": "2026-07-22T25:00:00Z"}, [("timestamp", "iso8601")]),
    ({"timestamp": "2026-07-22 18:00:00.123+02:00"}, []),
    ({"gps_lat": "91.0"}, [("gps_lat", "in_range[-90.0,90.0]")]),
    ({"gps_lat": "90", "gps_lon": "-180", "speed_mph": "120", "compute_load_pct": "0"}, []),
    ({"gps_lon": "-181.0"}, [("gps_lon", "in_range[-180.0,180.0]")]),
    ({"speed_mph": "9999.0"}, [("speed_mph", "in_range[0.0,120.0]")]),
    ({"speed_mph": "fast"}, [("speed_mph", "type:float")]),
    ({"speed_mph": "1.5d"}, [("speed_mph", "type:float")]),
    ({"speed_mph": " 1e2 "}, []),
    ({"speed_mph": "nan"}, []),
    ({"speed_mph": "inf"}, [("speed_mph", "in_range[0.0,120.0]")]),
    ({"speed_mph": None}, [("speed_mph", "type:float")]),
    ({"brake_pressure": "-0.1"}, [("brake_pressure", "ge:0")]),
    ({"brake_pressure": "x"}, [("brake_pressure", "type:float")]),
    ({"lidar_temp_c": ""}, [("lidar_temp_c", "type:float")]),
    ({"sensor_status": "SENSOR_STATUS_UNSPECIFIED"}, [("sensor_status", "enum:SensorStatus")]),
    ({"device_type": None}, [("device_type", "enum:DeviceType")]),
    (
        {"hardware_version": "", "vehicle_id": "BAD", "speed_mph": "-1"},
        [
            ("vehicle_id", "regex:^VH-[0-9]{4,8}$"),
            ("speed_mph", "in_range[0.0,120.0]"),
            ("hardware_version", "required_nonempty"),
        ],
    ),
]


def test_stream_rules_table(spark):
    df = frame(spark, *[c for c, _ in CASES])
    assert broken(df, contracts.stream_rules(df)) == [want for _, want in CASES]
    routes = [r.r for r in df.select(contracts.route(contracts.stream_rules(df)).alias("r")).collect()]
    assert routes == ["quarantine" if want else "validated" for _, want in CASES]


def test_messages_read_like_the_values(spark):
    df = frame(spark, {"vehicle_id": "NOPE", "speed_mph": "200.0", "sensor_status": None})
    found = df.select(contracts.violations(contracts.stream_rules(df)).alias("v")).first().v
    assert [v.message for v in found] == [
        "invalid vehicle_id: 'NOPE'",
        "speed_mph=200.0 outside [0.0, 120.0]",
        "invalid sensor_status: None",
    ]


def test_batch_contract_differs(spark):
    df = frame(
        spark,
        {"sensor_status": "SENSOR_STATUS_UNSPECIFIED", "trip_id": " "},
        {"speed_mph": "nan"},
        {"sensor_status": None},
    )
    assert broken(df, contracts.batch_rules(df)) == [
        [],
        [("speed_mph", "type:float")],
        [("sensor_status", "not_null")],
    ]
    extra = (*settings.TELEMETRY_FIELDS, "surprise")
    assert ("surprise", "unknown_column") in broken(df, contracts.batch_rules(df, extra))[0]


def test_producer_contract_strips_and_checks_symbols(spark):
    df = frame(
        spark,
        {"vehicle_id": " VH-0001 ", "sensor_status": " SENSOR_STATUS_OK"},
        {"sensor_status": "SENSOR_STATUS_UNSPECIFIED"},
        {"lidar_temp_c": "nan"},
        {"brake_pressure": "nan"},
    )
    got = broken(df, contracts.producer_rules(df))
    assert got[0] == [] and got[1] == [("sensor_status", "enum:SensorStatus")]
    assert got[2] == [] and got[3] == [("brake_pressure", "bounded")]


def test_rejection_gate(spark):
    triaged = contracts.triage(frame(spark, {}, {}, {}, {"speed_mph": "x"}))
    row = contracts.rejection_gate(triaged).first()
    assert (row.total_count, row.rejected_count, row.rejection_rate, row.publish) == (4, 1, 0.25, False)
    empty = contracts.rejection_gate(triaged.limit(0)).first()
    assert (empty.total_count, empty.rejection_rate, empty.publish) == (0, 0.0, True)


def test_structural_issues_in_order(spark):
    df = frame(
        spark,
        {"vehicle_id": " ", "timestamp": "x"},
        {"timestamp": "x", "gps_lat": "x"},
        {"gps_lon": None, "speed_mph": "x"},
        {"speed_mph": "x"},
        {"speed_mph": "9999", "lidar_temp_c": "warm", "device_type": "odd"},
    )
    got = norm.normalize(df)
    assert [r.issue for r in got.select("issue").collect()] == [
        "empty_vehicle_id",
        "unparseable_timestamp",
        "non_numeric_gps",
        "non_numeric_speed",
        None,
    ]
    strict = norm.normalize(df, encode_check=True).select("issue").collect()
    assert strict[-1].issue == "avro_encode_failed"
    record = norm.structural_quarantine(got, F.lit("2026-01-01").cast("timestamp")).first()
    assert (record.field, record.rule, record.reason) == (
        "vehicle_id",
        "required_nonempty",
        "vehicle_id is empty",
    )
    assert len(record.violations) == 1 and json.loads(record.raw_payload)["trip_id"] == "trip-1"


def test_decode_keeps_text_and_flags_raw(spark):
    values = [json.dumps({**GOOD, "speed_mph": 12.5}), "[1]", "{bad", '"x"', "null", '{"a": 1}', None]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = messages.decode(df).collect()
    assert [r.codec for r in got] == ["json", "raw", "raw", "raw", "raw", "json", "raw"]
    assert got[0].speed_mph == "12.5" and got[5].vehicle_id is None
    issues = norm.normalize(messages.decode(df)).select("issue").collect()
    assert issues[1].issue == "decode_failed" and issues[5].issue == "empty_vehicle_id"


@pytest.mark.parametrize(
    "text, want",
    [
        ("1721671200", "2024-07-22 18:00:00"),
        ("1721671200000", "2024-07-22 18:00:00"),
        ("1721671200.5", "2024-07-22 18:00:00.5"),
        (" 2024-07-22T18:00:00Z ", "2024-07-22 18:00:00"),
        ("2024-07-22T18:00:00+02:00", "2024-07-22 16:00:00"),
        ("2024-07", None),
        ("nan", None),
    ],
)
def test_polymorphic_timestamp(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce.any_instant(F.col("t")).cast("string")).first()[0] == want


def test_aliases_and_mentions(spark):
    df = spark.createDataFrame(
        [("ok", "vehicle", "why did vh- 007 stop"), ("SENSOR_STATUS_FAULT", "x", "VH-12345"), (None, None, "none")],
        "s string, d string, q string",
    )
    got = df.select(
        coerce.sensor_status(F.col("s")), coerce.device_type(F.col("d")), coerce.vehicle_mention(F.col("q"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("SENSOR_STATUS_OK", "DEVICE_TYPE_VEHICLE", "VH-0007"),
        ("SENSOR_STATUS_FAULT", "DEVICE_TYPE_UNSPECIFIED", "VH-12345"),
        ("SENSOR_STATUS_UNSPECIFIED", "DEVICE_TYPE_UNSPECIFIED", None),
    ]


def test_field_coverage(spark):
    payloads = [json.dumps(GOOD), json.dumps({"vehicle_id": "x", "odd": 1})]
    df = spark.createDataFrame([(p,) for p in payloads], "raw_payload string")
    got = {r.field: (r.in_contract, r.present, r.missing) for r in contracts.field_coverage(df).collect()}
    assert got["vehicle_id"] == (True, 2, 0) and got["trip_id"] == (True, 1, 1)
    assert got["odd"] == (False, 1, None) and len(got) == 13
