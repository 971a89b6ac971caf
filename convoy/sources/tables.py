"""Readers for the given tables, and the telemetry records derived from ``events``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.functions.coerce import computed_once
from convoy.session import prepare

# One telemetry record per event, kept dirty on purpose: blank and malformed ids, bad
# timestamps, impossible positions, unspecified symbols.
_TELEMETRY = {
    "event_id": "event_id",
    "event_ts": "cast(ts as timestamp)",
    "vehicle_id": """case when event_id % 97 = 0 then '' when event_id % 89 = 0 then 'BAD'
        else 'VH-' || lpad(cast(user_id as string), 7, '0') end""",
    "trip_id": """case when event_id % 83 = 0 then ''
        else 'trip-' || cast(user_id as string) || '-' || cast(cast(ts as date) as string) end""",
    "timestamp": """case when event_id % 79 = 0 then '' when event_id % 73 = 0 then 'NOT-A-DATE'
        else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || 'Z' end""",
    "gps_lat": """case when event_id % 71 = 0 then 999e0
        else 40.4406e0 + ((event_id % 400) - 200) / 1e4 end""",
    "gps_lon": """case when event_id % 71 = 0 then -999e0
        else -79.9959e0 + ((event_id % 300) - 150) / 1e4 end""",
    "speed_mph": "value",
    "brake_pressure": "(event_id % 100) / 1e2",
    "lidar_temp_c": "38e0 + value * 0.08e0",
    "compute_load_pct": "least(95e0, 25e0 + value * 0.6e0)",
    "sensor_status": """case when event_id % 61 = 0 then 'SENSOR_STATUS_UNSPECIFIED'
        when event_type = 'error' then 'SENSOR_STATUS_FAULT'
        when event_type = 'purchase' then 'SENSOR_STATUS_DEGRADED' else 'SENSOR_STATUS_OK' end""",
    "hardware_version": """case when event_id % 67 = 0 then '' when event_id % 3 = 0 then 'hw-rev-3.2'
        when event_id % 3 = 1 then 'hw-rev-3.3' else 'hw-rev-4.0-beta' end""",
    "device_type": """case event_type when 'signup' then 'DEVICE_TYPE_EDGE_GATEWAY'
        when 'click' then 'DEVICE_TYPE_VEHICLE' else 'DEVICE_TYPE_SIMULATOR' end""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def telemetry_of(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    derived = events.selectExpr(*keep, *[f"{expr} as {name}" for name, expr in _TELEMETRY.items()])
    return computed_once(derived, [*keep, "event_id", "event_ts"])


# The same records as JSON text without an event id: some cut short, with words or text numbers
# where numbers belong, or with a key that the contract does not know.
_MESSAGE = """concat('{"vehicle_id":"', vehicle_id, '","trip_id":"', trip_id, '","timestamp":"', timestamp,
    '","gps_lat":', if(event_id % 107 = 0, '"north"', cast(gps_lat as string)),
    ',"gps_lon":', cast(gps_lon as string),
    ',"speed_mph":', if(event_id % 103 = 0, '"fast"', cast(speed_mph as string)),
    ',"brake_pressure":', if(event_id % 113 = 0, '"0.5"', cast(brake_pressure as string)),
    ',"lidar_temp_c":', if(event_id % 109 = 0, '"hot"', cast(lidar_temp_c as string)),
    ',"compute_load_pct":', cast(compute_load_pct as string),
    ',"sensor_status":"', sensor_status, '","hardware_version":"', hardware_version,
    '","device_type":"', device_type, if(event_id % 127 = 0, '","operator":"x"}', '"}'))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All telemetry records as the text of messages (``value``)."""
    return telemetry(spark, sf_dir).selectExpr(
        f"if(event_id % 101 = 0, left({_MESSAGE}, 40), {_MESSAGE}) as value"
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the telemetry records that sensor frames are built from."""
    names = ("event_id", "event_ts", "gps_lat", "gps_lon", "speed_mph", "brake_pressure")
    events = table(spark, sf_dir, "events")
    return events.selectExpr("user_id", *[f"{_TELEMETRY[n]} as {n}" for n in names])


def drift_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_reports_of(table(spark, sf_dir, "events"))


def drift_reports_of(events: DataFrame) -> DataFrame:
    """Drift incidents derived from error events; every hundredth names no vehicle."""
    return events.where("event_type = 'error'").select(
        F.concat(F.lit("drift-"), F.col("event_id").cast("string")).alias("incident_id"),
        F.lit("INCIDENT_SEVERITY_CRITICAL").alias("severity"),
        F.lit("drift-monitor").alias("source_service"),
        F.lit("drifted_feature_count").alias("metric_name"),
        F.lit(2.0).alias("threshold"),
        (F.col("event_id") % 4).cast("double").alias("observed_value"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.lit("INCIDENT_STATUS_OPEN").alias("status"),
        F.when(
            F.col("event_id") % 100 != 0,
            F.concat(F.lit("VH-"), F.lpad(F.col("user_id").cast("string"), 7, "0")),
        ).alias("vehicle_id"),
        F.lit(None).cast("array<string>").alias("drifted_features"),
    )
