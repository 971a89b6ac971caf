"""Gold tables: feature statistics, quarantine audit, counters, and point-in-time lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import coerce
from convoy.operators import scan
from convoy.settings import FEATURES

_QUANTILES = {"p50": 0.5, "p95": 0.95}


def _device() -> Column:
    return F.coalesce("device_type", F.lit("DEVICE_TYPE_UNSPECIFIED")).alias("device_type")


def feature_statistics(df: DataFrame, *extra_keys: Column) -> DataFrame:
    """Rows, mean, population deviation, median and 95th percentile of each feature.

    Grouped by device type and any extra keys. Moments are partial aggregates. Quantiles are
    exact: a device type may hold a third of the rows, so its values are ranked in parts and
    never held by one task.
    """
    typed = df.select(
        _device(),
        *extra_keys,
        *[F.nanvl(coerce.numeric_field(df, f), F.lit(None)).alias(f) for f in FEATURES],
    )
    keys = [c for c in typed.columns if c not in FEATURES]
    moments = typed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.avg(f).alias(f"{f}_mean") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"{f}_std") for f in FEATURES],
    )
    long = typed.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
        ),
    )
    ranked = scan.exact_quantiles(long, [*keys, "feature"], "value", _QUANTILES)
    wide = ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("feature") == f, F.col(q))).alias(f"{f}_{q}")
            for f in FEATURES
            for q in _QUANTILES
        ]
    )
    ordered = [f"{f}_{s}" for f in FEATURES for s in ("mean", "std", "p50", "p95")]
    return moments.join(wide, keys, "left").select(*keys, "row_count", *ordered)


def daily_feature_statistics(df: DataFrame, at: str = "event_time") -> DataFrame:
    """Statistics per device type and day, computed at the end of that day."""
    stats = feature_statistics(df, F.to_date(at).alias("event_day"))
    return stats.withColumn("computed_at", F.date_add("event_day", 1).cast("timestamp"))


def features_as_of(events: DataFrame, stats: DataFrame, ttl_days: int = 7) -> DataFrame:
    """Latest statistics of the event's device type at or before the event, within the TTL.

    Each statistics row is valid from its time until the next row or the TTL. The interval is
    laid out by day, so the lookup is an equality join on (device type, day) with at most one
    match per event; events without one keep nulls. Which side moves is left to adaptive
    execution, which knows their sizes and splits heavy days.
    """
    by_device = Window.partitionBy("device_type").orderBy("computed_at")
    limit = F.col("computed_at") + F.make_dt_interval(F.lit(ttl_days))
    following = F.lead("computed_at").over(by_device)
    spans = (
        stats.drop("event_day")
        .withColumn("_next", following)
        .withColumn("_limit", limit)
        .withColumn(
            "_day",
            F.explode(
                F.sequence(
                    F.to_date("computed_at"), F.to_date(F.least("_limit", F.coalesce("_next", "_limit")))
                )
            ),
        )
    )
    valid = (
        (events["device_type"] == spans["device_type"])
        & (F.to_date(events["event_time"]) == spans["_day"])
        & (events["event_time"] >= spans["computed_at"])
        & (events["event_time"] <= spans["_limit"])
        & (spans["_next"].isNull() | (events["event_time"] < spans["_next"]))
    )
    found = [spans[c] for c in stats.columns if c not in ("device_type", "event_day")]
    return events.join(spans, valid, "left").select(*[events[c] for c in events.columns], *found)


def quarantine_audit(quarantine: DataFrame, top_n: int = 10) -> DataFrame:
    """Top reasons, fields and vehicles, all topics, and the total, in long form.

    Counts are partially aggregated, and the rank limit is applied before its shuffle too.
    """
    values = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).alias("key"))
            for name in ("reason", "field", "vehicle_id")
        ]
    )
    count = F.count(F.lit(1)).alias("count")
    counts = (
        quarantine.select(F.inline(values))
        .where("key is not null")
        .groupBy("dimension", "key")
        .agg(count)
    )
    order = Window.partitionBy("dimension").orderBy(F.desc("count"), "key")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    topics = quarantine.groupBy(F.coalesce("source_topic", F.lit("unknown")).alias("key")).agg(count)
    total = quarantine.agg(count)
    no_rank = F.lit(None).cast("int").alias("rank")
    return top.unionByName(
        topics.select(F.lit("source_topic").alias("dimension"), "key", "count", no_rank)
    ).unionByName(total.select(F.lit("total").alias("dimension"), F.lit("all").alias("key"), "count", no_rank))


def reason_histogram(quarantine: DataFrame, top_n: int = 20) -> DataFrame:
    return (
        quarantine.groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
        .limit(top_n)
    )


def lifetime_pass_ratio(gated: DataFrame) -> DataFrame:
    validated = F.count_if(F.col("route") == "validated")
    total = F.count(F.lit(1))
    return gated.agg(
        validated.alias("validated"),
        (total - validated).alias("quarantined"),
        F.when(total > 0, validated / total).otherwise(1.0).alias("pass_ratio"),
    )


def qa_counters(normalized: DataFrame, gated: DataFrame, windows: DataFrame) -> DataFrame:
    """Records consumed, decode failures, records per route, and windows emitted (one row)."""
    gate = gated.agg(
        F.count_if(F.col("route") == "validated").alias("validated"),
        F.count_if(F.col("route") == "quarantine").alias("quarantined"),
    )
    return normalized.agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(F.col("issue").isNotNull()).alias("structural_failures"),
        F.count_if(F.coalesce(F.col("issue") == "decode_failed", F.lit(False))).alias(
            "decode_failures"
        ),
    ).select(
        "*",
        gate.select("validated").scalar().alias("validated"),
        gate.select("quarantined").scalar().alias("quarantined"),
        windows.agg(F.count(F.lit(1))).scalar().alias("metrics_emitted"),
    )


def _newest(df: DataFrame, at: str, columns: list[str], limit: int) -> DataFrame:
    """The newest rows; the record's key settles equal times, so the choice is always the same."""
    key = [coerce.record_key(df).alias("_key")]
    ordered = df.select(*columns, *key).orderBy(F.desc(at), "vehicle_id", "_key").limit(limit)
    return ordered.drop("_key")


def latest_telemetry(df: DataFrame, limit: int = 50) -> DataFrame:
    return _newest(df, "timestamp", ["vehicle_id", "speed_mph", "gps_lat", "gps_lon", "timestamp"], limit)


def device_recent(df: DataFrame, device_type: str, limit: int = 10) -> DataFrame:
    mine = df.where(F.col("device_type") == device_type)
    return _newest(mine, "timestamp", ["vehicle_id", "speed_mph", "device_type", "timestamp"], limit)


def day_count(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col("event_day") == F.lit(day).cast("date")).agg(
        F.count(F.lit(1)).alias("events")
    )


def recent_quarantine(df: DataFrame, limit: int = 20) -> DataFrame:
    return _newest(df, "rejected_at", ["rejected_at", "vehicle_id", "field", "rule", "reason"], limit)


def vehicle_slice(df: DataFrame, vehicle_id: str, after: str | None = None) -> DataFrame:
    """Rows of one vehicle (every vehicle when empty), optionally after a time."""
    mine = df.where(F.col("vehicle_id") == vehicle_id) if vehicle_id else df
    return mine.where(F.col("timestamp") > F.lit(after).cast("timestamp")) if after else mine
