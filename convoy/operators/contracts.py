"""Contract rules as columns: violation lists, routing and quarantine records.

A rule is a ``bad`` condition and the message shown when it holds. Routing needs only the
conditions; the violation list is built where a record is actually quarantined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy import settings
from convoy.functions import coerce
from convoy.operators.normalize import VIOLATION


@dataclass(frozen=True)
class Rule:
    field: str
    name: str
    bad: Column
    message: Column


def _rule(field: str, name: str, bad: Column, message: Column | str) -> Rule:
    text = F.lit(message) if isinstance(message, str) else message
    return Rule(field, name, F.coalesce(bad, F.lit(False)), text)


def _nonempty(field: str, value: Column, *, trimmed: bool = True) -> Rule:
    empty = coerce.is_blank(value) if trimmed else value.isNull() | (value == "")
    return _rule(field, "required_nonempty", empty, f"{field} is required")


def _vehicle(value: Column) -> Rule:
    return _rule(
        "vehicle_id",
        f"regex:{settings.VEHICLE_ID_PATTERN}",
        ~F.coalesce(value.rlike(settings.VEHICLE_ID_PATTERN), F.lit(False)),
        F.concat(F.lit("invalid vehicle_id: "), coerce.quoted(value)),
    )


def _timestamp(value: Column, parsed: Column | None = None) -> list[Rule]:
    missing = value.isNull() | (value == "")
    instant = coerce.iso_instant(value) if parsed is None else parsed
    return [
        _rule("timestamp", "required", missing, "timestamp is required"),
        _rule(
            "timestamp",
            "iso8601",
            ~missing & instant.isNull(),
            F.concat(F.lit("timestamp not ISO-8601: "), coerce.quoted(value)),
        ),
    ]


def _not_a_number(df: DataFrame, field: str, reject_nan: bool) -> tuple[Column, Rule]:
    value = coerce.numeric_field(df, field)
    bad = value.isNull() | F.isnan(value) if reject_nan else value.isNull()
    given = coerce.given_text(field)
    shown = coerce.quoted(F.col(given if given in df.columns else field))
    return value, _rule(
        field, "type:float", bad, F.concat(F.lit(f"{field} must be numeric, got "), shown)
    )


def _range(df: DataFrame, field: str, reject_nan: bool) -> list[Rule]:
    lo, hi = settings.RANGES[field]
    value, typed = _not_a_number(df, field, reject_nan)
    # NaN compares false with everything here, so it passes the range itself.
    outside = ~F.isnan(value) & ((value < lo) | (value > hi))
    return [
        typed,
        _rule(
            field,
            f"in_range[{lo},{hi}]",
            outside,
            F.concat(
                F.lit(f"{field}="), value.cast("string"), F.lit(f" outside [{lo}, {hi}]")
            ),
        ),
    ]


def _floor(df: DataFrame, field: str, reject_nan: bool) -> list[Rule]:
    value, typed = _not_a_number(df, field, reject_nan)
    return [
        typed,
        _rule(
            field,
            "ge:0",
            value < 0.0,
            F.concat(F.lit(f"{field}="), value.cast("string"), F.lit(" must be >= 0")),
        ),
    ]


def _symbol(field: str, name: str, value: Column, allowed: Sequence[str]) -> Rule:
    return _rule(
        field,
        f"enum:{name}",
        ~F.coalesce(value.isin(*allowed), F.lit(False)),
        F.concat(F.lit(f"invalid {field}: "), coerce.quoted(value)),
    )


def _numbers(df: DataFrame, reject_nan: bool) -> list[Rule]:
    rules: list[Rule] = []
    for field in ("gps_lat", "gps_lon", "speed_mph", "compute_load_pct"):
        rules += _range(df, field, reject_nan)
    rules += _floor(df, "brake_pressure", reject_nan)
    rules.append(_not_a_number(df, "lidar_temp_c", reject_nan)[1])
    return rules


def stream_rules(df: DataFrame) -> list[Rule]:
    """The QA gate's rules, in the order violations are reported.

    Normalised records already carry the parsed instant; it is not parsed again.
    """
    parsed = F.col("event_time") if "event_time" in df.columns else None
    return [
        _vehicle(F.col("vehicle_id")),
        _nonempty("trip_id", F.col("trip_id")),
        *_timestamp(F.col("timestamp"), parsed),
        *_numbers(df, reject_nan=False),
        _symbol("sensor_status", "SensorStatus", F.col("sensor_status"), settings.SENSOR_STATUSES),
        _symbol("device_type", "DeviceType", F.col("device_type"), settings.DEVICE_TYPES),
        _nonempty("hardware_version", F.col("hardware_version")),
    ]


def _unknown_columns(names: Sequence[str], known: Sequence[str]) -> list[Rule]:
    return [
        _rule(name, "unknown_column", F.lit(True), f"{name} is not in the contract")
        for name in names
        if name not in known
    ]


def batch_rules(df: DataFrame, payload: Sequence[str] = settings.TELEMETRY_FIELDS) -> list[Rule]:
    """The batch contract: strict columns, no nulls or NaN, symbols unchecked, no trimming."""
    return [
        *_unknown_columns(payload, settings.TELEMETRY_FIELDS),
        _vehicle(F.col("vehicle_id")),
        _nonempty("trip_id", F.col("trip_id"), trimmed=False),
        *_timestamp(F.col("timestamp")),
        *_numbers(df, reject_nan=True),
        _rule("sensor_status", "not_null", F.col("sensor_status").isNull(), "sensor_status is null"),
        _rule("device_type", "not_null", F.col("device_type").isNull(), "device_type is null"),
        _nonempty("hardware_version", F.col("hardware_version"), trimmed=False),
    ]


def producer_rules(df: DataFrame, payload: Sequence[str] = settings.TELEMETRY_FIELDS) -> list[Rule]:
    """The producer contract: text is stripped first, extra fields forbidden, symbols checked.

    NaN passes it only where the field has no bound.
    """
    vehicle, sensor, device = (
        coerce.strip(F.col(c)) for c in ("vehicle_id", "sensor_status", "device_type")
    )
    bounded = [
        _rule(
            f,
            "bounded",
            F.isnan(coerce.numeric_field(df, f)),
            f"{f} must be within its bounds",
        )
        for f in (*settings.RANGES, "brake_pressure")
    ]
    return [
        *_unknown_columns(payload, settings.TELEMETRY_FIELDS),
        _vehicle(vehicle),
        _nonempty("trip_id", F.col("trip_id")),
        *_timestamp(coerce.strip(F.col("timestamp"))),
        *_numbers(df, reject_nan=False),
        *bounded,
        _symbol("sensor_status", "SensorStatus", sensor, settings.SENSOR_STATUSES),
        _symbol("device_type", "DeviceType", device, settings.DEVICE_TYPES),
        _nonempty("hardware_version", F.col("hardware_version")),
    ]


def incident_rules(df: DataFrame) -> list[Rule]:
    """The incident contract: ids present, symbols specified, both numbers numeric."""
    return [
        _nonempty("incident_id", F.col("incident_id")),
        _symbol(
            "severity",
            "IncidentSeverity",
            coerce.strip(F.col("severity")),
            settings.INCIDENT_SEVERITIES,
        ),
        _nonempty("source_service", F.col("source_service")),
        _nonempty("metric_name", F.col("metric_name")),
        _not_a_number(df, "threshold", False)[1],
        _not_a_number(df, "observed_value", False)[1],
        *_timestamp(coerce.strip(F.col("timestamp"))),
        _symbol(
            "status", "IncidentStatus", coerce.strip(F.col("status")), settings.INCIDENT_STATUSES
        ),
    ]


def passes(rules: Sequence[Rule]) -> Column:
    return ~reduce(lambda a, b: a | b, [r.bad for r in rules])


def violations(rules: Sequence[Rule]) -> Column:
    """All violations in rule order, as an array of (field, rule, message)."""
    found = [
        F.when(
            r.bad,
            F.struct(
                F.lit(r.field).alias("field"),
                F.lit(r.name).alias("rule"),
                F.coalesce(r.message, F.lit("")).alias("message"),
            ).cast(VIOLATION),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*found))


def route(rules: Sequence[Rule]) -> Column:
    return F.when(passes(rules), "validated").otherwise("quarantine")


def gate(normalized: DataFrame) -> DataFrame:
    """Normalised records with their ``route``."""
    return normalized.withColumn("route", route(stream_rules(normalized)))


def quarantine_records(
    normalized: DataFrame, rejected_at: Column, source_topic: str = "telemetry.normalized"
) -> DataFrame:
    """One record per row that breaks a rule: the first violation, all violations, payload."""
    rules = stream_rules(normalized)
    fields = F.to_json(F.struct(*settings.TELEMETRY_FIELDS))
    payload = F.col("payload") if "payload" in normalized.columns else fields
    bad = normalized.where(~passes(rules)).withColumn("violations", violations(rules))
    first = F.element_at("violations", 1)
    return bad.select(
        *[c for c in ("event_id",) if c in normalized.columns],
        rejected_at.alias("rejected_at"),
        F.lit(source_topic).alias("source_topic"),
        F.col("vehicle_id"),
        first["field"].alias("field"),
        first["rule"].alias("rule"),
        first["message"].alias("reason"),
        F.col("violations"),
        payload.alias("raw_payload"),
    )


def triage(df: DataFrame, payload: Sequence[str] = settings.TELEMETRY_FIELDS) -> DataFrame:
    """Batch contract per row: ``accepted``, ``rejection_reason`` and ``corruption_type``."""
    broken = violations(batch_rules(df, payload))
    reason = F.array_join(
        F.transform("_broken", lambda v: F.concat(v["field"], F.lit(": "), v["rule"])), "; "
    )
    ok = F.size("_broken") == 0
    return df.withColumn("_broken", broken).select(
        *df.columns,
        ok.alias("accepted"),
        F.when(~ok, reason).alias("rejection_reason"),
        F.when(~ok, "pandera_schema_error").alias("corruption_type"),
    )


def triage_messages(decoded: DataFrame) -> DataFrame:
    """Batch contract over decoded messages: payloads that are no objects are rejected as such.

    Fields whose text cannot be checked at all (a number too large to hold) count as errors of the
    validation itself.
    """
    rows = triage(decoded)
    raw = F.col("codec") == "raw"
    unheld = F.lit(False)
    for field in settings.FEATURES:
        value = coerce.numeric_field(decoded, field)
        unheld = unheld | (F.abs(value) == float("inf"))
    error = F.coalesce(unheld, F.lit(False))
    return rows.withColumns(
        {
            "accepted": F.col("accepted") & ~raw & ~error,
            "rejection_reason": F.when(raw, "record is not an object")
            .when(error, "record could not be validated")
            .otherwise(F.col("rejection_reason")),
            "corruption_type": F.when(raw, "invalid_record_type")
            .when(error, "validation_error")
            .otherwise(F.col("corruption_type")),
        }
    )


def rejection_gate(triaged: DataFrame, limit: float = 0.2) -> DataFrame:
    """One row: counts, rejection rate, and whether the batch may be published."""
    rejected = F.count_if(~F.col("accepted"))
    total = F.count(F.lit(1))
    rate = F.when(total > 0, rejected / total).otherwise(0.0)
    return triaged.agg(
        total.alias("total_count"),
        F.count_if("accepted").alias("valid_count"),
        rejected.alias("rejected_count"),
        F.round(rate, 6).alias("rejection_rate"),
        (rate <= limit).alias("publish"),
    )


def field_coverage(payloads: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """Per field of the contract: rows missing it; per other key: rows carrying it.

    The payloads' keys are counted with partial aggregation, so hot keys do not matter.
    """
    total = payloads.agg(F.count(F.lit(1)).alias("_total"))
    seen = (
        payloads.select(F.explode(F.array_distinct(F.json_object_keys(payload))).alias("field"))
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("present"))
    )
    known = payloads.sparkSession.createDataFrame(
        [(f,) for f in settings.TELEMETRY_FIELDS], "field string"
    ).withColumn("in_contract", F.lit(True))
    joined = known.join(seen, "field", "full").withColumns(
        {
            "in_contract": F.coalesce("in_contract", F.lit(False)),
            "present": F.coalesce("present", F.lit(0)),
            "_total": total.scalar(),
        }
    )
    return joined.select(
        "field",
        "in_contract",
        "present",
        F.when(F.col("in_contract"), F.col("_total") - F.col("present")).alias("missing"),
    )
