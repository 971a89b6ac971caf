"""Thresholds and vocabularies. Every value here is fixed by the telemetry contract."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: contract vocabulary -------------------------------------------------
VEHICLE_ID_PATTERN = "^VH-[0-9]{4,8}$"

SENSOR_STATUSES = ("SENSOR_STATUS_OK", "SENSOR_STATUS_DEGRADED", "SENSOR_STATUS_FAULT")
DEVICE_TYPES = ("DEVICE_TYPE_VEHICLE", "DEVICE_TYPE_EDGE_GATEWAY", "DEVICE_TYPE_SIMULATOR")
INCIDENT_SEVERITIES = (
    "INCIDENT_SEVERITY_INFO",
    "INCIDENT_SEVERITY_WARNING",
    "INCIDENT_SEVERITY_CRITICAL",
)
INCIDENT_STATUSES = (
    "INCIDENT_STATUS_OPEN",
    "INCIDENT_STATUS_ACKNOWLEDGED",
    "INCIDENT_STATUS_RESOLVED",
)

TELEMETRY_FIELDS = (
    "vehicle_id",
    "trip_id",
    "timestamp",
    "gps_lat",
    "gps_lon",
    "speed_mph",
    "brake_pressure",
    "lidar_temp_c",
    "compute_load_pct",
    "sensor_status",
    "hardware_version",
    "device_type",
)
NUMERIC_FIELDS = (
    "gps_lat",
    "gps_lon",
    "speed_mph",
    "brake_pressure",
    "lidar_temp_c",
    "compute_load_pct",
)
RANGES = {
    "gps_lat": (-90.0, 90.0),
    "gps_lon": (-180.0, 180.0),
    "speed_mph": (0.0, 120.0),
    "compute_load_pct": (0.0, 100.0),
}

# Monitored features, with the mean and deviation used for z-scores.
FEATURES = ("speed_mph", "brake_pressure", "lidar_temp_c", "compute_load_pct")
FEATURE_SCALE = {
    "speed_mph": (22.0, 19.7),
    "brake_pressure": (0.27, 0.20),
    "lidar_temp_c": (39.8, 1.8),
    "compute_load_pct": (40.7, 12.4),
}
# ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class QaSettings:
    window_size: int = 20
    rate_threshold: float = 0.15


@dataclass(frozen=True)
class PolicySettings:
    window_batches: int = 5
    rate_threshold: float = 0.15
    drift_min_features: int = 2
    consecutive_max: int = 3


@dataclass(frozen=True)
class BreakerSettings:
    cooldown_seconds: float = 60.0
    half_open_successes: int = 1
    # True: the call that ends the cooldown is itself the probe. False: it only opens it.
    probe_on_advance: bool = True


@dataclass(frozen=True)
class DriftSettings:
    warmup: int = 200
    baseline: int = 200
    window: int = 50
    stride: int = 1
    alpha: float = 0.05
    min_features: int = 2
    cosine_floor: float = 0.85
    euclidean_ceiling: float = 2.0


@dataclass(frozen=True)
class RetrainSettings:
    max_score: float = 0.5
    min_features: int = 2


@dataclass(frozen=True)
class SloSettings:
    pass_ratio: float = 0.99
    drift_score: float = 0.2
    open_breakers: float = 0.0
    trip_rate: float = 0.05
