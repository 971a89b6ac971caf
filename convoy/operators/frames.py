"""Sensor frames: poses, rendered summaries, calibration and fusion by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions import geometry as g
from convoy.operators import scan

KEYS = ["scenario_id", "timestamp"]

# --- fixed values: sensor defaults ------------------------------------------------------
LIDAR_BEAMS, LIDAR_MAX_RANGE_M, LIDAR_HEIGHT_M = 16, 80.0, 1.8
GROUND_RANGE_M, GROUND_ELEVATION_DEG, GROUND_INTENSITY = 20.0, -5.0, 0.2
CAMERA_WIDTH, CAMERA_HEIGHT, CAMERA_MOUNT_M = 64, 48, 1.5
RENDERER_BACKEND = "classical_proxy"
SCENARIO_TYPES = ("intersection", "highway_merge", "pedestrian_crossing", "hard_brake")
# ---------------------------------------------------------------------------------------


def frames_of(telemetry: DataFrame, agents: int = 3) -> DataFrame:
    """World frames from telemetry: the n-th record of a user is frame n of that scenario, and
    the next users' n-th records are its other agents.

    Each record is sent to the ``agents`` scenarios it appears in and grouped by (scenario,
    frame), so a group holds one row per slot at most. A slot's values are plain aggregates, which are
    hashed; lists of structs would be sorted.
    """
    keep = telemetry.select(
        F.col("user_id"),
        "event_ts",
        "event_id",
        "gps_lat",
        "gps_lon",
        "speed_mph",
        "brake_pressure",
        ((F.col("event_id") * 37) % 360).cast("double").alias("heading_deg"),
    )
    numbered = scan.keyed_sequence(keep, ["user_id"], ["event_ts", "event_id"], name="frame_idx")
    spread = numbered.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(agents - 1))))
    scenario = F.col("user_id") - F.col("_slot")
    values = ("gps_lat", "gps_lon", "speed_mph", "brake_pressure", "heading_deg")
    slots = range(agents)
    own = [F.max(F.when(F.col("_slot") == k, F.col(v))).alias(f"_{v}_{k}") for k in slots for v in values]
    there = [F.max(F.col("_slot") == k).alias(f"_there_{k}") for k in slots]

    def agent(k: int) -> Column:
        user = (F.col("scenario") + k).cast("string")
        return F.struct(
            F.lit(k).alias("slot"),
            F.concat(F.lit("VH-"), F.lpad(user, 7, "0")).alias("agent_id"),
            F.lit("ego" if k == 0 else "other").alias("role"),
            *[F.col(f"_{v}_{k}").alias(v) for v in values],
        )

    grouped = (
        spread.groupBy(scenario.alias("scenario"), "frame_idx")
        .agg(F.max(F.when(F.col("_slot") == 0, F.col("event_ts"))).alias("timestamp"), *own, *there)
        .where("timestamp is not null")
        .withColumn("agents", F.array_compact(F.array(*[F.when(F.col(f"_there_{k}"), agent(k)) for k in slots])))
    )
    types = F.array(*[F.lit(t) for t in SCENARIO_TYPES])
    ego = F.col("agents")[0]
    return grouped.select(
        F.concat(F.lit("scn-"), F.col("scenario").cast("string")).alias("scenario_id"),
        F.element_at(types, (F.col("scenario") % len(SCENARIO_TYPES) + 1).cast("int")).alias(
            "scenario_type"
        ),
        "frame_idx",
        "timestamp",
        ego["agent_id"].alias("ego_vehicle_id"),
        "agents",
        F.struct(
            F.lit(0.0).alias("collision_risk"),
            F.greatest(F.lit(0.0), 1.0 - ego["brake_pressure"]).alias("comfort"),
            F.col("frame_idx").cast("double").alias("progress"),
        ).alias("world_rewards"),
    )


def physics(
    frames: DataFrame,
    origin_lat: float = g.ORIGIN_LAT,
    origin_lon: float = g.ORIGIN_LON,
    height_m: float = g.AGENT_HEIGHT_M,
) -> DataFrame:
    """Add position, orientation and speed in m/s to every agent, and the frame's origin."""

    def pose(a: Column) -> Column:
        position = F.struct(
            g.local_x(a["gps_lon"], origin_lat, origin_lon).alias("x"),
            g.local_y(a["gps_lat"], origin_lat).alias("y"),
            F.lit(height_m).alias("z"),
        )
        return (
            a.withField("position", position)
            .withField("orientation", g.yaw_quaternion(a["heading_deg"]))
            .withField("linear_velocity_mps", a["speed_mph"] * g.MPS_PER_MPH)
        )

    return frames.withColumn("agents", F.transform("agents", pose)).withColumn(
        "origin", F.struct(F.lit(origin_lat).alias("lat"), F.lit(origin_lon).alias("lon"))
    )


def _ego() -> Column:
    return F.filter("agents", lambda a: a["role"] == "ego")[0]


def _extrinsics(height: float, yaw: Column) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        zero.alias("tx"), zero.alias("ty"), F.lit(height).alias("tz"),
        zero.alias("roll"), zero.alias("pitch"), yaw.alias("yaw"),
    )


def lidar(physical: DataFrame, beams: int = LIDAR_BEAMS, max_range_m: float = LIDAR_MAX_RANGE_M) -> DataFrame:
    """Range returns per other agent plus the ground ring, point count and digest."""
    others = F.filter("agents", lambda a: a["role"] != "ego")
    seen = F.transform(others, lambda a: g.range_return(a["position"], F.col("_ego")["position"]))
    # One literal, not made again for every frame.
    ring = F.array(
        *[
            F.struct(
                F.lit(GROUND_RANGE_M).alias("range_m"),
                F.lit(i * (360.0 / beams)).alias("azimuth_deg"),
                F.lit(GROUND_ELEVATION_DEG).alias("elevation_deg"),
                F.lit(GROUND_INTENSITY).alias("intensity"),
            )
            for i in range(beams)
        ]
    )
    # Counted without making the returns: where only the digest is read they are not worked out.
    points = F.size(others) + F.lit(beams)
    return (
        physical.withColumn("_ego", _ego())
        .withColumn("returns", F.concat(seen, ring))
        .select(
            "scenario_id",
            "frame_idx",
            "timestamp",
            "ego_vehicle_id",
            "returns",
            points.alias("lidar_n_points"),
            g.short_digest(
                F.col("scenario_id"), F.col("frame_idx").cast("string"), points.cast("string"), "lidar"
            ).alias("lidar_digest"),
            F.struct(F.lit(beams).alias("beams"), F.lit(max_range_m).alias("max_range_m")).alias(
                "lidar_intrinsics"
            ),
            _extrinsics(LIDAR_HEIGHT_M, F.lit(0.0)).alias("lidar_extrinsics"),
            F.lit(RENDERER_BACKEND).alias("renderer_backend"),
        )
    )


def camera(physical: DataFrame, width: int = CAMERA_WIDTH, height: int = CAMERA_HEIGHT) -> DataFrame:
    """Image summary (digest and brightness) and calibration of the ego camera."""
    at = F.col("_ego")["position"]
    density = F.least(F.lit(1.0), F.size("agents") / 5.0)
    brightness = 0.35 + 0.5 * density * (1.0 / (1.0 + F.abs(at["x"]) * 0.01))
    return physical.withColumn("_ego", _ego()).select(
        "scenario_id",
        "frame_idx",
        "timestamp",
        "ego_vehicle_id",
        g.short_digest(
            F.col("scenario_id"),
            F.col("frame_idx").cast("string"),
            F.format_string("%.2f", at["x"]),
            F.format_string("%.2f", at["y"]),
            "camera",
        ).alias("camera_digest"),
        F.round(brightness, 4).alias("camera_mean_intensity"),
        F.struct(
            F.lit(width * 0.9).alias("fx"),
            F.lit(height * 0.9).alias("fy"),
            F.lit(width / 2.0).alias("cx"),
            F.lit(height / 2.0).alias("cy"),
        ).alias("camera_intrinsics"),
        _extrinsics(CAMERA_MOUNT_M, g.yaw_degrees(F.col("_ego")["orientation"])).alias("camera_extrinsics"),
        F.lit(RENDERER_BACKEND).alias("renderer_backend"),
    )


def last_per_time(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (scenario, time): the one with the highest frame index.

    A partial aggregate, so repeats of one instant never gather in a window.
    """
    return df.groupBy(*KEYS).agg(
        F.max_by(F.struct(*keep), "frame_idx").alias("_r"), F.count(F.lit(1)).alias("copies")
    ).select(*KEYS, "_r.*", "copies")


def fuse_calibration(cameras: DataFrame, lidars: DataFrame) -> DataFrame:
    """Camera and lidar calibration of each frame, matched on (scenario, time)."""
    lid = last_per_time(lidars, ["lidar_intrinsics", "lidar_extrinsics"]).drop("copies")
    return cameras.join(lid, KEYS).select(
        *KEYS,
        "frame_idx",
        "ego_vehicle_id",
        "camera_intrinsics",
        "camera_extrinsics",
        "lidar_intrinsics",
        "lidar_extrinsics",
    )


def fuse_sensors(physical: DataFrame, cameras: DataFrame, lidars: DataFrame) -> DataFrame:
    """Physics, camera and lidar of each frame in one row, matched on (scenario, time)."""
    cam = last_per_time(cameras, ["camera_digest", "camera_mean_intensity", "renderer_backend"])
    lid = last_per_time(lidars, ["lidar_digest", "lidar_n_points"])
    return (
        physical.join(cam.drop("copies"), KEYS)
        .join(lid.drop("copies"), KEYS)
        .select(
            *KEYS,
            "scenario_type",
            "frame_idx",
            "ego_vehicle_id",
            "camera_digest",
            "lidar_digest",
            "camera_mean_intensity",
            "lidar_n_points",
            F.to_json("agents").alias("agents_json"),
            F.to_json("world_rewards").alias("world_rewards_json"),
            "renderer_backend",
        )
    )


def unmatched(frames: DataFrame, *peers: DataFrame) -> DataFrame:
    """Frames that lack a peer; must be empty before a fusion is published."""
    gaps = [frames.select(*KEYS).join(p.select(*KEYS), KEYS, "left_anti") for p in peers]
    out = gaps[0]
    for gap in gaps[1:]:
        out = out.unionByName(gap)
    return out


def ground_truth_rows(physical: DataFrame) -> DataFrame:
    return physical.select(
        "scenario_id",
        "scenario_type",
        F.col("frame_idx").cast("double").alias("frame_idx"),
        "timestamp",
        "ego_vehicle_id",
        F.to_json("agents").alias("agents_json"),
        F.to_json("world_rewards").alias("world_rewards_json"),
        F.col("origin.lat").alias("origin_lat"),
        F.col("origin.lon").alias("origin_lon"),
    )


def sensor_rows(fused: DataFrame) -> DataFrame:
    return fused.select(
        "scenario_id",
        "scenario_type",
        F.col("frame_idx").cast("double").alias("frame_idx"),
        "timestamp",
        "ego_vehicle_id",
        "camera_digest",
        "lidar_digest",
        F.col("camera_mean_intensity").cast("double").alias("camera_mean_intensity"),
        F.col("lidar_n_points").cast("double").alias("lidar_n_points"),
        "agents_json",
        "world_rewards_json",
        "renderer_backend",
    )


def calibration_rows(bundles: DataFrame) -> DataFrame:
    parts = ("camera_intrinsics", "camera_extrinsics", "lidar_intrinsics", "lidar_extrinsics")
    return bundles.select(
        "scenario_id",
        F.col("frame_idx").cast("double").alias("frame_idx"),
        "timestamp",
        "ego_vehicle_id",
        *[F.to_json(p).alias(f"{p}_json") for p in parts],
    )


def publish_fusion(physical: DataFrame, peers: dict[str, DataFrame], fused: str, quarantine: str) -> None:
    """Write complete frames to ``fused`` and the rest, with the peers they lack, to ``quarantine``.

    ``peers`` has a camera and a lidar frame. No frame is left out of both tables.
    """
    held = physical
    for name, peer in peers.items():
        mark = peer.select(*KEYS).distinct().withColumn(f"_has_{name}", F.lit(True))
        held = held.join(mark, KEYS, "left")
    lacking = [F.when(F.col(f"_has_{name}").isNull(), F.lit(name)) for name in peers]
    held.select(*KEYS, F.concat_ws(",", *lacking).alias("missing")).where("missing <> ''").write.parquet(quarantine)
    fuse_sensors(physical, peers["camera"], peers["lidar"]).write.parquet(fused)
