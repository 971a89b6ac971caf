"""Geometry of sensor frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------
METERS_PER_DEGREE_LAT = 111_320.0
MPS_PER_MPH = 0.44704
ORIGIN_LAT, ORIGIN_LON = 40.4406, -79.9959
AGENT_HEIGHT_M = 1.5
# ---------------------------------------------------------------------------------------


def local_x(lon: Column, origin_lat: float, origin_lon: float) -> Column:
    return (lon - origin_lon) * METERS_PER_DEGREE_LAT * F.cos(F.radians(F.lit(origin_lat)))


def local_y(lat: Column, origin_lat: float) -> Column:
    return (lat - origin_lat) * METERS_PER_DEGREE_LAT


def yaw_quaternion(heading_deg: Column) -> Column:
    half = F.radians(heading_deg) * 0.5
    return F.struct(
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw")
    )


def yaw_degrees(orientation: Column) -> Column:
    return F.degrees(F.atan2(orientation["qz"], orientation["qw"]) * 2.0)


def range_return(position: Column, ego: Column) -> Column:
    """Distance, bearing, elevation and intensity of one agent seen from the ego agent."""
    dx, dy, dz = (position[c] - ego[c] for c in ("x", "y", "z"))
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.struct(
        F.round(distance, 3).alias("range_m"),
        F.round(F.degrees(F.atan2(dy, dx)), 2).alias("azimuth_deg"),
        F.round(F.degrees(F.atan2(dz, F.greatest(distance, F.lit(1e-3)))), 2).alias("elevation_deg"),
        F.round(F.greatest(F.lit(0.05), 1.0 / (1.0 + distance * 0.05)), 3).alias("intensity"),
    )


def short_digest(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 16)
