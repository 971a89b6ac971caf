"""Structural normalisation: type coercion only, out-of-range values pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy import settings
from convoy.functions import coerce

VIOLATION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# --- fixed values: structural issues as (field, rule, reason) ---------------------------
STRUCTURAL_ISSUES = {
    "empty_vehicle_id": ("vehicle_id", "required_nonempty", "vehicle_id is empty"),
    "unparseable_timestamp": ("timestamp", "iso8601", "timestamp is missing or unparseable"),
    "non_numeric_gps": ("gps_lat", "type:float", "gps_lat/gps_lon must be numeric"),
    "non_numeric_speed": ("speed_mph", "type:float", "speed_mph must be numeric"),
    "decode_failed": ("_payload", "decode", "kafka value could not be decoded"),
    "avro_encode_failed": ("_payload", "avro_encode", "normalized record not Avro-encodable"),
}
# ---------------------------------------------------------------------------------------

_SOFT_NUMBERS = ("brake_pressure", "lidar_temp_c", "compute_load_pct")
# The column that carries a record's payload as it came.
PAYLOAD = "payload"
_NAMES = ("trip_id", "sensor_status", "hardware_version", "device_type")


def _unencodable(df: DataFrame) -> Column:
    """True for rows a strict schema encoder refuses: a missing field, an unknown symbol,
    or text left in a numeric field."""
    sensors = (*settings.SENSOR_STATUSES, "SENSOR_STATUS_UNSPECIFIED")
    devices = (*settings.DEVICE_TYPES, "DEVICE_TYPE_UNSPECIFIED")
    refused = F.lit(False)
    for name in _NAMES:
        refused = refused | F.col(name).isNull()
    for name in _SOFT_NUMBERS:
        refused = refused | coerce.numeric_field(df, name).isNull()
    return (
        refused
        | ~F.coalesce(F.col("sensor_status").isin(*sensors), F.lit(False))
        | ~F.coalesce(F.col("device_type").isin(*devices), F.lit(False))
    )


def normalize(df: DataFrame, *, encode_check: bool = False) -> DataFrame:
    """Coerce raw records and add ``event_time`` and ``issue``.

    ``issue`` names the first structural failure in the order vehicle, timestamp, position,
    speed; it is null for a record that goes on to the QA gate. Soft numeric fields become
    doubles; where the source held text, it stays beside them, so that the gate can show it.
    ``event_id`` is added where the source has none, and the payload is kept as it came.
    """
    soft = {}
    for name in _SOFT_NUMBERS:
        soft[name] = coerce.numeric_field(df, name)
        if isinstance(df.schema[name].dataType, T.StringType):
            soft[coerce.given_text(name)] = F.col(name)
    held = F.col("raw_value") if "raw_value" in df.columns else as_json(df)
    lat, lon = coerce.numeric_field(df, "gps_lat"), coerce.numeric_field(df, "gps_lon")
    speed = coerce.numeric_field(df, "speed_mph")
    instant = coerce.iso_instant(F.col("timestamp"))
    issue = (
        F.when(coerce.is_blank(F.col("vehicle_id")), "empty_vehicle_id")
        .when(instant.isNull(), "unparseable_timestamp")
        .when(lat.isNull() | lon.isNull(), "non_numeric_gps")
        .when(speed.isNull(), "non_numeric_speed")
    )
    if "codec" in df.columns:
        issue = F.when(F.col("codec") == "raw", "decode_failed").otherwise(issue)
    if encode_check:
        issue = F.coalesce(issue, F.when(_unencodable(df), "avro_encode_failed"))
    return df.withColumns(
        {
            "vehicle_id": coerce.strip(F.col("vehicle_id")),
            "event_time": instant,
            "gps_lat": lat,
            "gps_lon": lon,
            "speed_mph": speed,
            "issue": issue,
            "event_id": coerce.record_key(df),
            PAYLOAD: held,
            **soft,
        }
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("issue").isNull()).drop("issue")


def as_json(df: DataFrame) -> Column:
    """The contract's fields as they stand, as JSON."""
    return F.to_json(F.struct(*[c for c in settings.TELEMETRY_FIELDS if c in df.columns]))


def _lookup(index: int) -> Column:
    chosen = F.lit(None).cast("string")
    for issue, parts in STRUCTURAL_ISSUES.items():
        chosen = F.when(F.col("issue") == issue, parts[index]).otherwise(chosen)
    return chosen


def structural_quarantine(
    normalized: DataFrame, rejected_at: Column, source_topic: str = "telemetry.raw"
) -> DataFrame:
    """Quarantine records of the rows that have a structural issue, with their untouched payload."""
    found = F.struct(
        _lookup(0).alias("field"), _lookup(1).alias("rule"), _lookup(2).alias("message")
    ).cast(VIOLATION)
    return normalized.where(F.col("issue").isNotNull()).select(
        "event_id",
        rejected_at.alias("rejected_at"),
        F.lit(source_topic).alias("source_topic"),
        F.col("vehicle_id"),
        _lookup(0).alias("field"),
        _lookup(1).alias("rule"),
        _lookup(2).alias("reason"),
        F.array(found).alias("violations"),
        F.col(PAYLOAD).alias("raw_payload"),
    )
