"""Registered queries: each reads the given tables whole and composes the operators.

Instants leave as text with microseconds, so that any engine can compare them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy import session, settings
from convoy.functions import coerce
from convoy.functions import policy as rules
from convoy.functions import text as tx
from convoy.operators import (
    breaker,
    cells,
    contracts,
    drift,
    episodes,
    frames,
    gold,
    retrain,
    search,
    slo,
    windows,
)
from convoy.operators import guarded_sql as sql_guard
from convoy.operators import normalize as norm
from convoy.sources import lake, message_log, messages, tables
from convoy.streaming import drift_stream, jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The event table averages one event per four minutes, so service levels use wide windows.
SLOT = "6 hours"
# Some breaker queries use a cooldown of the same order as the time between events.
SLOW_BREAKER = settings.BreakerSettings(cooldown_seconds=2 * 86_400.0)
# A drift stride of one window, for the tumbling variant.
TUMBLING = settings.DriftSettings(stride=50)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text_of(instant: Column | str) -> Column:
    column = F.col(instant) if isinstance(instant, str) else instant
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _shown(df: DataFrame, *instants: str) -> DataFrame:
    return df.withColumns({c: text_of(c) for c in instants})


# --- shared steps ----------------------------------------------------------------------


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return norm.normalize(tables.telemetry(spark, sf))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return norm.accepted(normalized(spark, sf))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.gate(accepted(spark, sf))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).where("route = 'validated'")


def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.quarantine_records(accepted(spark, sf), F.col("event_ts"))


def closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.count_windows(windows.outcomes(gated(spark, sf)))


def quality(spark: SparkSession, sf: str) -> DataFrame:
    return windows.rolling_quality(closed_windows(spark, sf))


def timeline(
    spark: SparkSession, sf: str, cfg: settings.BreakerSettings = settings.BreakerSettings()
) -> DataFrame:
    return breaker.evaluate(quality(spark, sf), tables.drift_reports(spark, sf), cfg=cfg)


def sequence(spark: SparkSession, sf: str, shifted: bool = False) -> DataFrame:
    rows = validated(spark, sf).select("event_time", "event_id", *settings.FEATURES)
    numbered = windows.drift_sequence(rows)
    if shifted:
        # The last 40 % of the time range drives faster.
        span = rows.agg(
            (F.unix_micros(F.min("event_time")) * 0.4 + F.unix_micros(F.max("event_time")) * 0.6).alias("at")
        ).scalar()
        late = F.unix_micros("event_time") >= span
        numbered = numbered.withColumn("speed_mph", F.col("speed_mph") + F.when(late, 45.0).otherwise(0.0))
    return numbered


def drift_windows_of(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return drift.windows(sequence(spark, sf), **kw)


def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.signals(drift_windows_of(spark, sf), windows.every_nth(F.col("window_no") + 1))


# --- normalisation and contracts --------------------------------------------------------


@query
def normalize_structural(spark: SparkSession, sf: str) -> DataFrame:
    out = norm.structural_quarantine(normalized(spark, sf), F.col("event_ts"))
    return out.select(
        "event_id", text_of("rejected_at").alias("rejected_at"), "source_topic", "vehicle_id",
        "field", "rule", "reason", F.size("violations").cast("long").alias("n_violations"),
    )


# --- messages: the same records as JSON text, without an event id -----------------------


def message_rows(spark: SparkSession, sf: str) -> DataFrame:
    return norm.normalize(messages.decode(tables.messages(spark, sf)))


def message_gate(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.gate(norm.accepted(message_rows(spark, sf)))


@query
def message_decode(spark: SparkSession, sf: str) -> DataFrame:
    return message_rows(spark, sf).select(
        F.col("event_id").alias("record_key"), "codec", "vehicle_id", "issue", "speed_mph", "brake_pressure",
        "lidar_temp_c", "lidar_temp_c_text", text_of("event_time").alias("event_time"),
    )


@query
def message_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit("2024-02-01").cast("timestamp")
    rows = message_rows(spark, sf)
    columns = ["event_id", "source_topic", "vehicle_id", "field", "rule", "reason", "raw_payload"]
    early = norm.structural_quarantine(rows, at).select(columns)
    late = contracts.quarantine_records(norm.accepted(rows), at).select(columns)
    return early.unionByName(late).withColumnRenamed("event_id", "record_key")


@query
def message_windows(spark: SparkSession, sf: str) -> DataFrame:
    closed = windows.count_windows(windows.outcomes(message_gate(spark, sf)))
    return _shown(closed.select("vehicle_id", "window_no", "total", "quarantined", "exceeded", "window_end"), "window_end")


@query
def message_drift(spark: SparkSession, sf: str) -> DataFrame:
    good = message_gate(spark, sf).where("route = 'validated'")
    rows = good.select("event_time", "event_id", *settings.FEATURES)
    return _window_rows(drift.windows(windows.drift_sequence(rows), drift=TUMBLING))


@query
def message_breaker(spark: SparkSession, sf: str) -> DataFrame:
    quality_rows = windows.rolling_quality(windows.count_windows(windows.outcomes(message_gate(spark, sf))))
    return _timeline_rows(breaker.evaluate(quality_rows, tables.drift_reports(spark, sf)))


@query
def normalized_records(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(
        "event_id", "vehicle_id", "trip_id", coerce.iso_text(F.col("event_time")).alias("timestamp"),
        "gps_lat", "gps_lon", "speed_mph",
    )


@query
def timestamp_forms(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    form = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(F.col("event_id") % 3 == 1, F.unix_seconds(at).cast("string"))
        .otherwise(F.unix_millis(at).cast("string"))
    )
    return tables.table(spark, sf, "events").select(
        "event_id", form.alias("form"), text_of(coerce.any_instant(form)).alias("instant")
    )


@query
def enum_aliases(spark: SparkSession, sf: str) -> DataFrame:
    short = F.regexp_replace("sensor_status", "^SENSOR_STATUS_", "")
    kind = F.lower(F.regexp_replace("device_type", "^DEVICE_TYPE_", ""))
    return tables.telemetry(spark, sf).select(
        "event_id",
        coerce.sensor_status(F.when(F.col("event_id") % 2 == 0, F.lower(short)).otherwise(F.col("sensor_status"))).alias("sensor_status"),
        coerce.device_type(F.when(F.col("event_id") % 5 == 0, F.lit("drone")).otherwise(kind)).alias("device_type"),
    )


@query
def qa_route_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gold.qa_counters(normalized(spark, sf), gated(spark, sf), closed_windows(spark, sf))


@query
def qa_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = accepted(spark, sf)
    found = rows.select("event_id", F.posexplode(contracts.violations(contracts.stream_rules(rows))).alias("position", "v"))
    return found.select("event_id", F.col("position").cast("long").alias("position"), "v.field", "v.rule", "v.message")


@query
def quarantine_records(spark: SparkSession, sf: str) -> DataFrame:
    return quarantined(spark, sf).select(
        "event_id", text_of("rejected_at").alias("rejected_at"), "source_topic", "vehicle_id", "field",
        "rule", "reason", F.size("violations").cast("long").alias("n_violations"),
        F.get_json_object("raw_payload", "$.trip_id").alias("payload_trip"),
    )


@query
def batch_contract_triage(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.triage(tables.telemetry(spark, sf)).select(
        "event_id", "accepted", "rejection_reason", "corruption_type"
    )


@query
def batch_rejection_gate(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.rejection_gate(contracts.triage(tables.telemetry(spark, sf)))


@query
def producer_contract(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.telemetry(spark, sf)
    padded = raw.withColumn("vehicle_id", F.concat(F.lit(" "), "vehicle_id", F.lit(" ")))
    broken = contracts.violations(contracts.producer_rules(padded))
    return padded.select("event_id", broken.alias("v")).select(
        "event_id",
        (F.size("v") == 0).alias("accepted"),
        F.array_join(F.col("v.field"), ",").alias("fields"),
    )


@query
def incident_contract(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.drift_reports(spark, sf).withColumns(
        {
            "timestamp": coerce.iso_text(F.col("event_time")),
            "severity": F.when(F.col("observed_value") == 0, "INCIDENT_SEVERITY_UNSPECIFIED").otherwise(F.col("severity")),
            "metric_name": F.when(F.col("observed_value") == 1, " ").otherwise(F.col("metric_name")),
        }
    )
    broken = contracts.violations(contracts.incident_rules(raw))
    return raw.select("incident_id", broken.alias("v")).select(
        "incident_id",
        (F.size("v") == 0).alias("accepted"),
        F.array_join(F.col("v.rule"), ",").alias("rules"),
    )


@query
def contract_coverage(spark: SparkSession, sf: str) -> DataFrame:
    payload = tables.telemetry(spark, sf).select(
        F.to_json(
            F.struct(
                *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("vehicle_id", "trip_id", "hardware_version")],
                F.nullif("timestamp", F.lit("")).alias("timestamp"),
                *[c for c in settings.NUMERIC_FIELDS],
                "sensor_status",
                "device_type",
                F.when(F.col("event_id") % 10 == 0, F.lit("x")).alias("extra_key"),
            )
        ).alias("raw_payload")
    )
    return contracts.field_coverage(payload).fillna(0, ["missing"])


# --- count windows, policy, breaker, episodes -------------------------------------------


@query
def qa_window_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(
        closed_windows(spark, sf).select(
            "vehicle_id", "window_no", "total", "quarantined", "quarantine_rate", "exceeded", "window_end"
        ),
        "window_end",
    )


@query
def qa_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return quality(spark, sf).select(
        "vehicle_id", "window_no", F.round("rolling_rate", 6).alias("rolling_rate"), "batch_count", "streak"
    )


@query
def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    events = breaker.correlated_events(quality(spark, sf), tables.drift_reports(spark, sf))
    return rules.decide(events).select(
        "vehicle_id", text_of("event_time").alias("event_time"), F.col("kind").cast("long").alias("kind"), "ref",
        F.round("rolling_rate", 6).alias("rolling_rate"), "batch_count", "streak", "drift_count",
        "trip", "severity", "route", F.array_join("reasons", "; ").alias("reasons"),
    )


def _timeline_rows(states: DataFrame) -> DataFrame:
    return states.select(
        "vehicle_id", text_of("event_time").alias("event_time"), "ref", "prior_state", "state",
        "tripped", "recovered", "trip_count", text_of("opened_at").alias("opened_at"),
    )


@query
def breaker_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline_rows(timeline(spark, sf))


@query
def breaker_timeline_slow(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline_rows(timeline(spark, sf, SLOW_BREAKER))


def _snapshot(spark: SparkSession, sf: str, moment: str) -> DataFrame:
    at = F.lit(moment).cast("timestamp")
    return breaker.snapshot(timeline(spark, sf, SLOW_BREAKER), at, SLOW_BREAKER).select(
        "vehicle_id", "state", F.col("state_code").cast("long").alias("state_code"), "trip_count",
        text_of("last_event").alias("last_event"),
    )


@query
def breaker_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf, "2024-01-31 00:00:00")


@query
def breaker_snapshot_midway(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot(spark, sf, "2024-01-10 00:00:00")


def _episode_rows(table: DataFrame) -> DataFrame:
    return table.select(
        "incident_id", "vehicle_id", "status", "severity", "route", text_of("first_trip").alias("first_trip"),
        text_of("last_trip").alias("last_trip"), text_of("resolved_at").alias("resolved_at"),
        "resolve_reason", "retrip_count", "open", "summary",
    )


@query
def incident_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _episode_rows(episodes.episodes(timeline(spark, sf)))


def _actions(table: DataFrame) -> DataFrame:
    """Operators acknowledge each episode after an hour and resolve it after a day and a half."""
    plan = F.array(
        F.struct(F.lit("acknowledge").alias("action"), F.lit(3600).alias("after"), F.lit("seen").alias("note")),
        F.struct(F.lit("resolve").alias("action"), F.lit(129_600).alias("after"), F.lit("").alias("note")),
    )
    return table.select("incident_id", "first_trip", F.inline(plan)).select(
        "incident_id",
        "action",
        (F.col("first_trip") + F.make_dt_interval(secs=F.col("after"))).alias("action_at"),
        "note",
    )


@query
def incident_actions(spark: SparkSession, sf: str) -> DataFrame:
    states = session.cut(timeline(spark, sf, SLOW_BREAKER))
    log = _actions(episodes.episodes(states))
    return _episode_rows(episodes.episodes(states, log))


@query
def incident_action_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    states = session.cut(timeline(spark, sf, SLOW_BREAKER))
    log = session.cut(_actions(episodes.episodes(states)))
    out = episodes.action_outcomes(episodes.episodes(states, log), log)
    return _shown(out, "action_at")


@query
def incident_list(spark: SparkSession, sf: str) -> DataFrame:
    table = episodes.with_status(episodes.episodes(timeline(spark, sf, SLOW_BREAKER)), "resolved")
    listed, count = episodes.for_vehicle(table, "vh-0000000")
    return listed.select("incident_id", "vehicle_id", "status", "retrip_count", count.scalar().alias("full_count"))


@query
def incident_summary(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.summaries(episodes.episodes(timeline(spark, sf, SLOW_BREAKER)))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    archived = tables.drift_reports(spark, sf).select(
        "incident_id",
        rules.incident_vehicle(F.col("vehicle_id")).alias("vehicle_id"),
        "severity",
        "status",
        F.lit("distribution drift").alias("reason"),
        "source_service",
        "observed_value",
    )
    live = episodes.summaries(episodes.episodes(timeline(spark, sf, SLOW_BREAKER)))
    return episodes.history(archived, live)


@query
def incident_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


@query
def incident_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = search.chunk_incidents(_history(spark, sf))
    return chunks.select(
        "chunk_id", "incident_id", "vehicle_id", "severity", "reason",
        F.get_json_object("text", "$.vehicle_id").alias("text_vehicle"),
        F.get_json_object("text", "$.status").alias("text_status"),
        F.array_join(F.json_object_keys("text"), ",").alias("text_keys"),
    )


@query
def notifications(spark: SparkSession, sf: str) -> DataFrame:
    table = episodes.episodes(timeline(spark, sf, SLOW_BREAKER))
    sent = episodes.notifications(table, "Fleet", "#fleet-alerts", "fleet-production")
    return sent.select(
        "incident_id", "target", F.col("slack.channel").alias("channel"), F.col("slack.text").alias("text"),
        F.col("pagerduty.payload.summary").alias("summary"), F.col("pagerduty.payload.severity").alias("severity"),
        F.col("pagerduty.dedup_key").alias("dedup_key"),
    )


# --- gold -------------------------------------------------------------------------------


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(gold.feature_statistics(validated(spark, sf)), "device_type", "row_count")


@query
def feature_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = validated(spark, sf)
    stats = gold.daily_feature_statistics(rows)
    events = rows.select("event_id", "event_time", "device_type")
    return gold.features_as_of(events, stats).select(
        "event_id", text_of("computed_at").alias("computed_at"), F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.round("speed_mph_mean", 6).alias("speed_mph_mean"), F.round("speed_mph_p95", 6).alias("speed_mph_p95"),
    )


@query
def quarantine_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = gold.quarantine_audit(quarantined(spark, sf))
    return out.withColumn("rank", F.coalesce(F.col("rank"), F.lit(0)).cast("long"))


@query
def reason_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return gold.reason_histogram(quarantined(spark, sf))


@query
def lifetime_pass_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return gold.lifetime_pass_ratio(gated(spark, sf)).withColumn("pass_ratio", F.round("pass_ratio", 6))


@query
def latest_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(gold.latest_telemetry(lake.telemetry_rows(validated(spark, sf))), "timestamp")


def _lake_table(spark: SparkSession, sf: str) -> DataFrame:
    """The validated records in the partitioned telemetry table."""
    path = session.new_dir(spark, "telemetry")
    lake.append_telemetry(lake.telemetry_rows(validated(spark, sf)), path)
    return lake.load(spark, path)


@query
def device_recent(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lake_table(spark, sf)
    return _shown(gold.device_recent(rows, "DEVICE_TYPE_SIMULATOR"), "timestamp")


@query
def day_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gold.day_count(_lake_table(spark, sf), "2024-01-15")


@query
def vehicle_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lake_table(spark, sf)
    mine = gold.vehicle_slice(rows, "VH-0000007", "2024-01-10 00:00:00")
    return mine.select("event_id", "vehicle_id", text_of("timestamp").alias("timestamp"), "speed_mph")


@query
def retention(spark: SparkSession, sf: str) -> DataFrame:
    scored = drift_windows_of(spark, sf, drift=TUMBLING)
    reports = scored.select("window_no", "window_end")
    kept = windows.split_retention(reports, [F.col("window_end"), F.col("window_no")], 48)
    return kept.select("window_no", "expired")


@query
def incident_retention(spark: SparkSession, sf: str) -> DataFrame:
    table = episodes.episodes(timeline(spark, sf, SLOW_BREAKER))
    kept = windows.split_retention(table, [F.col("first_trip"), F.col("incident_id")], 500)
    return kept.select("incident_id", "expired")


# --- drift ------------------------------------------------------------------------------


@query
def ks_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = drift.long_features(
        validated(spark, sf).withColumn("current", F.col("device_type") == "DEVICE_TYPE_VEHICLE"), ["current"]
    )
    out = drift.two_sample(rows, ["feature"], "value", "current")
    return out.select(
        "feature", "n_current", "n_reference", F.round("ks_statistic", 6).alias("ks_statistic"), "drift_detected"
    )


def _order_line_features(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity and price of returned order lines against all others."""
    return tables.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("current"),
        F.inline(
            F.array(
                F.struct(F.lit("quantity").alias("feature"), F.col("l_quantity").cast("double").alias("value")),
                F.struct(F.lit("price").alias("feature"), F.col("l_extendedprice").cast("double").alias("value")),
            )
        ),
    )


@query
def ks_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.two_sample(_order_line_features(spark, sf), ["feature"], "value", "current")
    return out.select(
        "feature", "n_current", "n_reference", F.round("ks_statistic", 6).alias("ks_statistic"), "drift_detected"
    )


@query
def ks_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """Significance of the same tests, from the limiting distribution."""
    out = drift.two_sample(_order_line_features(spark, sf), ["feature"], "value", "current")
    return out.select("feature", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("p_value", 9).alias("p_value"))


@query
def column_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = validated(spark, sf)
    middle = F.lit("2024-01-16").cast("timestamp")
    out = drift.column_drift(rows.where(F.col("event_time") < middle), rows.where(F.col("event_time") >= middle))
    return out.select("feature", F.round("drift_score", 6).alias("drift_score"), "drift_detected")


@query
def column_drift_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = validated(spark, sf)
    # Simulators against all other devices.
    simulated = F.col("device_type") == "DEVICE_TYPE_SIMULATOR"
    scores = drift.column_drift(rows.where(~simulated), rows.where(simulated))
    return drift.drifted_share(scores)


@query
def embedding_centroids(spark: SparkSession, sf: str) -> DataFrame:
    rows = validated(spark, sf)
    middle = F.lit("2024-01-16").cast("timestamp")
    out = drift.centroid_metrics(rows.where(F.col("event_time") >= middle), rows.where(F.col("event_time") < middle))
    return out.select(
        F.round("mean_cosine_similarity", 6).alias("mean_cosine_similarity"),
        F.round("mean_euclidean_distance", 6).alias("mean_euclidean_distance"),
        "drift_detected",
    )


def _window_rows(scored: DataFrame) -> DataFrame:
    return scored.select(
        "window_no",
        text_of("window_end").alias("window_end"),
        *[F.round(f"{n}_score", 6).alias(f"{n}_score") for n in drift.SCORED],
        F.array_join("drifted_features", ",").alias("drifted_features"),
        "drifted_count",
        F.round("cosine_similarity", 6).alias("cosine_similarity"),
        F.round("euclidean_distance", 6).alias("euclidean_distance"),
        "centroid_drift",
        "breached",
        "rising",
    )


@query
def drift_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _window_rows(drift_windows_of(spark, sf))


@query
def drift_windows_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _window_rows(drift_windows_of(spark, sf, drift=TUMBLING))


@query
def drift_windows_shifted(spark: SparkSession, sf: str) -> DataFrame:
    return _window_rows(drift.windows(sequence(spark, sf, shifted=True)))


@query
def drift_incidents(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.incidents(drift_windows_of(spark, sf))
    return out.select(
        "incident_id", "severity", "metric_name", "threshold", "observed_value",
        text_of("event_time").alias("event_time"), F.array_join("drifted_features", ",").alias("drifted_features"),
    )


@query
def drift_every_n(spark: SparkSession, sf: str) -> DataFrame:
    scored = drift_windows_of(spark, sf)
    return scored.where(windows.every_nth(F.col("window_no") + 1)).select(
        "window_no", text_of("window_end").alias("window_end")
    )


@query
def baseline_staleness(spark: SparkSession, sf: str) -> DataFrame:
    return windows.baseline_staleness(sequence(spark, sf)).select(
        "event_id", "seq", "phase", F.round("staleness_seconds", 6).alias("staleness_seconds")
    )


@query
def drift_score_average(spark: SparkSession, sf: str) -> DataFrame:
    out = slo.drift_score_average(drift_windows_of(spark, sf), drift.SCORED)
    return out.select("window_no", F.round("drift_score_avg", 6).alias("drift_score_avg"))


def _signal_columns(df: DataFrame) -> list[Column]:
    return [
        text_of("generated_at").alias("generated_at"), F.col("window_size").cast("long").alias("window_size"),
        F.col("drifted_feature_count").cast("long").alias("drifted_feature_count"),
        F.round("max_drift_score", 6).alias("max_drift_score"),
    ]


@query
def latest_signal(spark: SparkSession, sf: str) -> DataFrame:
    out = retrain.latest(signal_table(spark, sf))
    return out.select(*_signal_columns(out))


@query
def retrain_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = retrain.decide(signal_table(spark, sf))
    return out.select(*_signal_columns(out), "should_retrain", "reason")


@query
def retrain_without_signal(spark: SparkSession, sf: str) -> DataFrame:
    """No window of this table scores above 1, so no signal is left and the decision is the default."""
    none = signal_table(spark, sf).where("max_drift_score > 1.0")
    out = retrain.decide_latest(none)
    return out.select("should_retrain", "reason", "max_drift_score", "drifted_feature_count")


@query
def retrain_latest(spark: SparkSession, sf: str) -> DataFrame:
    out = retrain.decide_latest(signal_table(spark, sf))
    return out.select(
        "should_retrain", "reason", F.round("max_drift_score", 6).alias("max_drift_score"), "drifted_feature_count"
    )


@query
def retrain_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = retrain.runs(retrain.decide(signal_table(spark, sf)))
    return out.select(
        "trigger_id", "event_type", text_of("triggered_at").alias("triggered_at"), "trigger_reason",
        F.round(F.col("feature_scores")["speed_mph"], 6).alias("speed_score"),
    )


# --- service levels ---------------------------------------------------------------------


@query
def pass_ratio_5m(spark: SparkSession, sf: str) -> DataFrame:
    out = slo.pass_ratio(gated(spark, sf))
    return _shown(out.drop("window_end"), "window_start").withColumn("pass_ratio", F.round("pass_ratio", 6))


@query
def throughput_2s(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(slo.throughput(accepted(spark, sf)).drop("window_end"), "window_start")


@query
def operational_rates(spark: SparkSession, sf: str) -> DataFrame:
    gate, incidents = gated(spark, sf), tables.drift_reports(spark, sf)
    trips = session.cut(timeline(spark, sf, SLOW_BREAKER).where("tripped").select("event_time"))
    all_rows = F.lit("all").alias("result")
    rates = [
        ("escalations_5m", slo.event_rate(trips, "5 minutes").withColumn("result", all_rows)),
        ("escalations_15m", slo.event_rate(trips, "15 minutes").withColumn("result", all_rows)),
        ("ingest_2m", slo.event_rate(gate, "2 minutes").withColumn("result", all_rows)),
        ("qa_records_1m", slo.event_rate(gate, "1 minute", by=["route"]).withColumnRenamed("route", "result")),
        ("incident_events_5m", slo.event_rate(incidents, "5 minutes").withColumn("result", all_rows)),
    ]
    out = None
    for name, rate in rates:
        named = rate.select(
            F.lit(name).alias("rate"), text_of("window_start").alias("window_start"), "result", "events",
            F.round("per_second", 9).alias("per_second"),
        )
        out = named if out is None else out.unionByName(named)
    return out


@query
def open_breakers(spark: SparkSession, sf: str) -> DataFrame:
    out = slo.open_breakers(timeline(spark, sf, SLOW_BREAKER), SLOT)
    return _shown(out.drop("window_end"), "window_start").withColumn(
        "breaker_trip_rate", F.round("breaker_trip_rate", 9)
    )


@query
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("event_time"), "value")
    out = slo.latency_quantiles(events, "value", SLOT)
    return _rounded(_shown(out, "window_start"), "window_start")


@query
def latency_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The events' values, as tenths of a second, in latency buckets."""
    events = tables.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("event_time"), (F.col("value") / 10).alias("seconds")
    )
    return _rounded(_shown(slo.bucket_latency(events, "seconds", SLOT), "window_start"), "window_start", "total")


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    # Parsed and checked once, for the three measures.
    rows = session.cut(gated(spark, sf).select("route", "vehicle_id", "event_time", "event_id", *settings.FEATURES))
    ratio = slo.pass_ratio(rows, SLOT)
    closed = windows.count_windows(windows.outcomes(rows), settle=False)
    states = breaker.evaluate(windows.rolling_quality(closed), tables.drift_reports(spark, sf), cfg=SLOW_BREAKER)
    states = session.cut(slo.open_breakers(states, SLOT))
    numbered = windows.drift_sequence(
        rows.where("route = 'validated'").select("event_time", "event_id", *settings.FEATURES), settle=False
    )
    score = slo.drift_score_average(drift.windows(numbered, drift=TUMBLING), drift.SCORED)
    return (
        slo.samples("qa_pass_ratio", ratio, "window_end", "pass_ratio")
        .unionByName(slo.samples("breakers_open", states, "window_end", "breakers_open"))
        .unionByName(slo.samples("breaker_trip_rate", states, "window_end", "breaker_trip_rate"))
        .unionByName(slo.samples("drift_score_avg", score, "window_end", "drift_score_avg"))
    )


@query
def sustained_alerts(spark: SparkSession, sf: str) -> DataFrame:
    # Samples are hours apart, so a breach has to hold for a day.
    hold = {metric: 86_400 for metric in slo.ALERTS}
    out = slo.sustained_alerts(_samples(spark, sf), hold)
    return _shown(out.withColumn("value", F.round("value", 6)), "active_since", "last_breached")


@query
def slo_report(spark: SparkSession, sf: str) -> DataFrame:
    newest = _samples(spark, sf).groupBy("metric").agg(F.max_by("value", "at").alias("value"))
    return slo.report(newest)


# --- frames -----------------------------------------------------------------------------


def _physics(spark: SparkSession, sf: str) -> DataFrame:
    return frames.physics(frames.frames_of(tables.frame_records(spark, sf)))


@query
def frame_geometry(spark: SparkSession, sf: str) -> DataFrame:
    agent = _physics(spark, sf).select("scenario_id", "frame_idx", F.explode("agents").alias("a"))
    return agent.select(
        "scenario_id", "frame_idx", F.col("a.agent_id").alias("agent_id"), F.col("a.role").alias("role"),
        F.round("a.position.x", 6).alias("x"), F.round("a.position.y", 6).alias("y"),
        F.round("a.orientation.qz", 6).alias("qz"), F.round("a.orientation.qw", 6).alias("qw"),
        F.round("a.linear_velocity_mps", 6).alias("mps"),
    )


@query
def lidar_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.lidar(_physics(spark, sf))
    # No frame is without its ring. A plain posexplode filters on the size first, by making all returns twice.
    return rows.select(
        "scenario_id", "frame_idx", F.posexplode_outer("returns").alias("point", "r")
    ).select(
        "scenario_id", "frame_idx", F.col("point").cast("long").alias("point"), "r.range_m", "r.azimuth_deg",
        "r.elevation_deg", "r.intensity",
    )


@query
def sensor_fusion(spark: SparkSession, sf: str) -> DataFrame:
    physical = _physics(spark, sf)
    fused = frames.fuse_sensors(physical, frames.camera(physical), frames.lidar(physical))
    return fused.select(
        "scenario_id", text_of("timestamp").alias("timestamp"), "scenario_type", "frame_idx", "ego_vehicle_id",
        "camera_digest", "lidar_digest", "camera_mean_intensity",
        F.col("lidar_n_points").cast("long").alias("lidar_n_points"), "renderer_backend",
    )


@query
def calibration_fusion(spark: SparkSession, sf: str) -> DataFrame:
    physical = _physics(spark, sf)
    fused = frames.fuse_calibration(frames.camera(physical), frames.lidar(physical))
    return fused.select(
        "scenario_id", "frame_idx", text_of("timestamp").alias("timestamp"),
        F.round("camera_intrinsics.fx", 6).alias("fx"), F.round("camera_intrinsics.fy", 6).alias("fy"),
        F.col("camera_intrinsics.cx").alias("cx"), F.col("camera_intrinsics.cy").alias("cy"),
        F.round("camera_extrinsics.yaw", 6).alias("camera_yaw"),
        F.col("lidar_intrinsics.beams").cast("long").alias("beams"), F.col("lidar_extrinsics.tz").alias("lidar_tz"),
    )


@query
def fusion_gaps(spark: SparkSession, sf: str) -> DataFrame:
    physical = _physics(spark, sf)
    # Frames in which the ego stands still lose their lidar peer.
    lidars = frames.lidar(physical.where(F.col("agents")[0]["speed_mph"] >= 5.0))
    gaps = frames.unmatched(physical, frames.camera(physical), lidars)
    return _shown(gaps, "timestamp")


@query
def fusion_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "fusion")
    physical = _physics(spark, sf)
    lidars = frames.lidar(physical.where(F.col("agents")[0]["speed_mph"] >= 5.0))
    fused, held = os.path.join(root, "fused"), os.path.join(root, "quarantine")
    frames.publish_fusion(physical, {"camera": frames.camera(physical), "lidar": lidars}, fused, held)
    good = spark.read.parquet(fused).select("scenario_id", "timestamp", F.lit("fused").alias("outcome"), F.lit("").alias("missing"))
    bad = spark.read.parquet(held).select("scenario_id", "timestamp", F.lit("quarantine").alias("outcome"), "missing")
    return _shown(good.unionByName(bad), "timestamp")


# --- text and vectors -------------------------------------------------------------------


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return search.chunk_documents(tables.table(spark, sf, "documents"), "doc_id", "text")


@query
def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "text", "title")


@query
def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    base = search.chunk_documents(docs, "doc_id", "text").select("chunk_id", "text", F.lit(1).alias("version"))
    edited = docs.where("lang = 'en'").withColumn("text", F.concat(F.lit("Second edition. "), "text"))
    changes = search.chunk_documents(edited, "doc_id", "text").select("chunk_id", "text", F.lit(2).alias("version"))
    out = search.upsert(base, changes, "chunk_id", "version")
    return out.select("chunk_id", "point_id", "text", F.col("version").cast("long").alias("version"))


@query
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vector")
    return search.embed(_chunks(spark, sf)).select(
        "chunk_id", F.size(v).cast("long").alias("dim"),
        *[F.round(v[i], 6).alias(f"v{i}") for i in (0, 1, 7, 8, 200, 383)],
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = search.top_k(vectors, vectors, 5, exclude_self=True)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def vector_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the search by cells finds nine in ten of the exact search's hits, over all vectors."""
    vectors = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = search.top_k(vectors, vectors, 5, exclude_self=True).select("query_id", "item_id")
    found = cells.near(vectors, vectors, 5, recall=0.9, exclude_self=True).select("query_id", "item_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "item_id"], "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("wanted"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
    )


@query
def retrieval(spark: SparkSession, sf: str) -> DataFrame:
    questions = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    hits = search.retrieve(questions, search.embed(_chunks(spark, sf)))
    return hits.select(
        "query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "title"
    )


@query
def injection_filter(spark: SparkSession, sf: str) -> DataFrame:
    reason = tx.question_reason(F.col("text"))
    return tables.table(spark, sf, "conversations").select(
        "conv_id", "turn", reason.isNull().alias("ok"), reason.alias("reason"),
        F.when(reason.isNull(), tx.without_wrappers(F.col("text"))).alias("sanitized"),
    )


@query
def vehicle_mentions(spark: SparkSession, sf: str) -> DataFrame:
    said = tables.telemetry(spark, sf).select(
        "event_id",
        F.concat(F.lit("why did "), F.lower("vehicle_id"), F.lit(" on "), "trip_id", F.lit(" stop?")).alias("question"),
    )
    return said.select("event_id", coerce.vehicle_mention(F.col("question")).alias("vehicle_id"))


@query
def guarded_sql(spark: SparkSession, sf: str) -> DataFrame:
    sql_guard.register_views(lake.telemetry_rows(validated(spark, sf)), quarantined(spark, sf))
    try:
        # The plan holds the views' own plans once it is analysed.
        return sql_guard.query(
            spark,
            "SELECT t.device_type, count(*) AS records, round(avg(t.speed_mph), 6) AS mean_speed,"
            " (SELECT count(*) FROM fleet.quarantine) AS rejected"
            " FROM fleet.telemetry t GROUP BY t.device_type",
            limit=100,
        )
    finally:
        sql_guard.drop_views(spark)


# --- lake -------------------------------------------------------------------------------


@query
def lake_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = session.new_dir(spark, "telemetry")
    lake.append_telemetry(lake.telemetry_rows(validated(spark, sf)), path)
    back = lake.load(spark, path)
    return back.select(
        "event_id", "vehicle_id", text_of("timestamp").alias("timestamp"), "speed_mph", "device_type",
        F.col("event_day").cast("string").alias("event_day"),
    )


@query
def lake_map_errors(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.telemetry(spark, sf)
    return lake.map_counters(lake.telemetry_rows(raw))


@query
def quarantine_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = session.new_dir(spark, "quarantine")
    lake.append_quarantine(lake.quarantine_rows(quarantined(spark, sf)), path)
    back = lake.load(spark, path)
    return back.select(
        "event_id", text_of("rejected_at").alias("rejected_at"), "vehicle_id", "field", "reason",
        F.get_json_object("violations_json", "$[0].rule").alias("rule"),
        F.get_json_object("raw_payload_json", "$.hardware_version").alias("hardware_version"),
        F.col("reject_day").cast("string").alias("reject_day"),
    )


@query
def recent_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(gold.recent_quarantine(quarantined(spark, sf)), "rejected_at")


@query
def frame_tables_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    physical = session.cut(_physics(spark, sf))
    cameras, lidars = frames.camera(physical), frames.lidar(physical)
    root = session.new_dir(spark, "frames")
    lake.append_frames(frames.ground_truth_rows(physical), os.path.join(root, "scenario_ground_truth"))
    fused = frames.fuse_sensors(physical, cameras, lidars)
    lake.append_frames(frames.sensor_rows(fused), os.path.join(root, "synthetic_sensor_data"))
    bundles = frames.fuse_calibration(cameras, lidars)
    lake.append_frames(frames.calibration_rows(bundles), os.path.join(root, "sensor_calibration"))
    truth = lake.load(spark, os.path.join(root, "scenario_ground_truth"))
    sensor = lake.load(spark, os.path.join(root, "synthetic_sensor_data"))
    calibration = lake.load(spark, os.path.join(root, "sensor_calibration"))
    keys = ["scenario_id", "timestamp"]
    both = truth.select(*keys, "scenario_type", "frame_idx", "origin_lat", F.col("event_day").cast("string").alias("event_day")).join(
        sensor.select(*keys, "lidar_n_points", "camera_digest"), keys
    ).join(calibration.select(*keys, F.get_json_object("camera_intrinsics_json", "$.cx").cast("double").alias("cx")), keys)
    return _shown(both, "timestamp")


def _published(spark: SparkSession, sf: str, limit: float) -> DataFrame:
    root = session.new_dir(spark, "serverless")
    triaged = contracts.triage(tables.telemetry(spark, sf))
    publish = contracts.rejection_gate(triaged, limit).first()["publish"]
    good = triaged.where("accepted").drop("accepted", "rejection_reason", "corruption_type")
    rejected = triaged.where("not accepted")
    for _ in range(2):  # The second publication replaces the first.
        lake.publish_batch(good if publish else good.where("false"), os.path.join(root, "telemetry"), "2024-01-31", "exec-1")
        lake.dead_letter(rejected, os.path.join(root, "dead_letter"), "exec-1")
    published = spark.read.schema(good.schema).parquet(os.path.join(root, "telemetry"))
    letters = spark.read.json(os.path.join(root, "dead_letter"))
    return (
        published.select("event_id", F.lit("published").alias("outcome"), F.lit(None).cast("string").alias("reason"))
        .unionByName(letters.select("event_id", F.lit("dead_letter").alias("outcome"), F.col("rejection_reason").alias("reason")))
    )


@query
def batch_publish(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf, 0.2)


@query
def batch_publish_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """More records are rejected than this limit allows: only the dead letters are written."""
    return _published(spark, sf, 0.05)


@query
def message_triage(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts.triage_messages(messages.decode(tables.messages(spark, sf)))
    return rows.groupBy(F.coalesce("corruption_type", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("records"), F.max(F.md5(F.col("raw_value").cast("binary"))).alias("largest_key")
    )


@query
def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    path = session.new_dir(spark, "commits")
    rows = lake.telemetry_rows(validated(spark, sf)).where("not map_error").drop("map_error")
    cuts = [None, "2024-01-11", "2024-01-21", None]  # the first and the last commit are open
    for number, (low, high) in enumerate(zip(cuts, cuts[1:]), start=1):
        part = rows
        if low:
            part = part.where(F.col("event_day") >= F.lit(low).cast("date"))
        if high:
            part = part.where(F.col("event_day") < F.lit(high).cast("date"))
        lake.commit(part, path, number)
    return lake.as_of(spark, path, 2).groupBy("device_type").agg(
        F.count(F.lit(1)).alias("records"), F.max("commit_id").cast("long").alias("newest_commit")
    )


@query
def gold_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    path = session.new_dir(spark, "gold")
    lake.write_gold(gold.feature_statistics(validated(spark, sf)), path)
    as_json = spark.read.json(os.path.join(path, "feature_statistics_json"))
    table = spark.read.parquet(os.path.join(path, "feature_statistics"))
    return table.join(as_json.select("device_type", F.col("row_count").alias("json_rows")), "device_type").select(
        "device_type", "row_count", "json_rows", F.round("speed_mph_p50", 6).alias("speed_mph_p50")
    )


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = tables.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _raw_stream(spark: SparkSession, sf: str) -> DataFrame:
    return tables.telemetry_of(_event_stream(spark, sf))


@query
def stream_normalize(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "stream-normalize")
    jobs.drain(
        jobs.normalize_stream(_raw_stream(spark, sf), F.col("event_ts"), root, os.path.join(root, "checkpoint"))
    )
    good, bad = (jobs.committed(spark, root, n) for n in ("normalized", "quarantine"))
    return good.select("event_id", "vehicle_id", F.lit("normalized").alias("topic"), F.lit(None).cast("string").alias("rule")).unionByName(
        bad.select("event_id", "vehicle_id", F.lit("quarantine").alias("topic"), "rule")
    )


@query
def stream_qa(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "stream-qa")
    rows = norm.accepted(norm.normalize(_raw_stream(spark, sf)))
    jobs.drain(jobs.gate_stream(rows, F.col("event_ts"), root, os.path.join(root, "checkpoint")))
    good, bad = (jobs.committed(spark, root, n) for n in ("validated", "quarantine"))
    return good.select("event_id", F.lit("validated").alias("topic"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", F.lit("quarantine").alias("topic"), "reason")
    )


# Records of the logs arrive up to so much later than they were sent; the watermark waits for them.
LATENESS_SECONDS = 12 * 3600
DELAY = "1 day"
# A vehicle sends two records a day or so here: ranges of ten days hold some twenty of them.
RANGE_SECONDS = 10 * 86_400
MICRO_BATCHES = 3


def _to_log(rows: DataFrame, at: str, key: str, path: str) -> None:
    """``rows`` as JSON messages sent at ``at``, in an order of arrival that is not that of sending."""
    held = [
        F.unix_micros(F.col(c).cast("timestamp")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes
    ]
    late = F.pmod(F.xxhash64(key), F.lit(LATENESS_SECONDS * 1_000_000))
    records = rows.select(
        F.col(at).cast("timestamp").alias("sent_at"),
        F.to_json(F.struct(*held)).alias("value"),
        (F.unix_micros(F.col(at).cast("timestamp")) + late).alias("arrival"),
        F.col(key).cast("string").alias("key"),
    )
    message_log.append(records, path, F.col("key"), ["arrival", "key"])


def _clock_on(spark: SparkSession, path: str) -> None:
    """A record without a value, sent long after all others: it only moves the watermark."""
    late = F.lit("2100-01-01").cast("timestamp").alias("sent_at")
    tick = spark.range(1).select(late, F.lit(None).cast("string").alias("value"), "id")
    message_log.append(tick, path, F.col("id"), ["id"])


def _from_log(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The log's rows again, as a stream of several micro-batches with ``sent_at`` as its clock."""
    per_trigger = -(-sum(message_log.ends(path).values()) // MICRO_BATCHES)
    messages = message_log.stream(spark, path, max(1, per_trigger), f"{path}-progress").withWatermark("sent_at", DELAY)
    as_sent = T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType) else f.dataType) for f in schema]
    )
    rows = messages.select("sent_at", F.from_json("value", as_sent).alias("m")).select("sent_at", "m.*")
    instants = [f.name for f in schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType)]
    return rows.withColumns({c: F.timestamp_micros(c) for c in instants})


@query
def stream_route_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counters observed while the records of two streams pass."""
    root = session.new_dir(spark, "stream-counters")
    paths = [os.path.join(root, n) for n in ("normalize", "gate", "lake")]
    at, raw = F.col("event_ts"), _raw_stream(spark, sf)
    accepted_rows = norm.accepted(norm.normalize(raw))
    good = contracts.gate(accepted_rows).where("route = 'validated'")
    jobs.drain(jobs.normalize_stream(raw, at, paths[0], f"{paths[0]}-checkpoint"))
    jobs.drain(jobs.gate_stream(accepted_rows, at, paths[1], f"{paths[1]}-checkpoint"))
    jobs.drain(jobs.lake_stream(good, paths[2], f"{paths[2]}-checkpoint"))
    first, routes, mapped = (jobs.committed(spark, p, "counters") for p in paths)
    by_route = routes.agg(
        *[F.sum(F.when(F.col("route") == r, F.col("records"))).alias(n) for r, n in (("validated", "validated"), ("quarantine", "quarantined"))]
    )
    totals = first.agg(*[F.sum(c).alias(c) for c in ("consumed", "structural_failures", "decode_failures")])
    lake_totals = mapped.agg(*[F.sum(c).alias(c) for c in ("appended", "map_errors")])
    return totals.select(
        "*",
        *[by_route.select(c).scalar().alias(c) for c in ("validated", "quarantined")],
        *[lake_totals.select(c).scalar().alias(c) for c in ("appended", "map_errors")],
    )


@query
def stream_qa_window(spark: SparkSession, sf: str) -> DataFrame:
    stateful.use_state_store(spark)
    root = session.new_dir(spark, "stream-window")
    events, log = tables.table(spark, sf, "events"), os.path.join(root, "events")
    _to_log(events, "ts", "event_id", log)
    records = tables.telemetry_of(_from_log(spark, events.schema, log), ("sent_at",))
    rows = contracts.gate(norm.accepted(norm.normalize(records)))
    closed = stateful.count_windows(windows.outcomes(rows, "sent_at"), width_seconds=RANGE_SECONDS, clock="sent_at")
    metrics = jobs.table_stream(closed, os.path.join(root, "metrics"), os.path.join(root, "checkpoint"))
    jobs.drain_log(metrics, lambda: _clock_on(spark, log))
    return _shown(spark.read.parquet(os.path.join(root, "metrics")), "window_end")


def _breaker_stream(spark: SparkSession, sf: str, root: str, cfg: settings.BreakerSettings) -> tuple[DataFrame, Callable]:
    """The breaker over two live logs, of closed windows and of drift reports, and what ends their wait."""
    stateful.use_state_store(spark)
    closed = closed_windows(spark, sf).withColumn("name", F.concat_ws("/", "vehicle_id", "window_no"))
    reports = tables.drift_reports(spark, sf)
    paths = [os.path.join(root, n) for n in ("qa_metrics", "reports")]
    _to_log(closed, "window_end", "name", paths[0])
    _to_log(reports, "event_time", "incident_id", paths[1])
    states = stateful.correlate(
        _from_log(spark, closed.schema, paths[0]).drop("window_end").withColumnRenamed("sent_at", "window_end"),
        _from_log(spark, reports.schema, paths[1]).drop("event_time").withColumnRenamed("sent_at", "event_time"),
        cfg=cfg,
        width_seconds=RANGE_SECONDS,
    )
    return states, lambda: [_clock_on(spark, p) for p in paths]


@query
def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "stream-breaker")
    states, close = _breaker_stream(spark, sf, root, SLOW_BREAKER)
    jobs.drain_log(jobs.table_stream(states, os.path.join(root, "states"), os.path.join(root, "checkpoint")), close)
    back = spark.read.parquet(os.path.join(root, "states"))
    return back.select(
        "vehicle_id", text_of("event_time").alias("event_time"), "ref", "prior_state", "state", "tripped",
        "recovered", "trip_count", text_of("first_trip").alias("first_trip"), "retrip_count", "route",
    )


@query
def stream_breaker_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The breakers out of the stream's own state, after it has taken in all events."""
    root = session.new_dir(spark, "stream-snapshot")
    checkpoint = os.path.join(root, "checkpoint")
    states, close = _breaker_stream(spark, sf, root, SLOW_BREAKER)
    jobs.drain_log(jobs.table_stream(states, os.path.join(root, "states"), checkpoint), close)
    live = stateful.live_breakers(spark, checkpoint, F.lit("2024-01-31").cast("timestamp"), SLOW_BREAKER)
    return live.select(
        "vehicle_id", "state", F.col("state_code").cast("long").alias("state_code"), "trip_count",
        text_of("last_event").alias("last_event"),
    )


@query
def stream_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes kept by upserts from the breaker's transitions."""
    root = session.new_dir(spark, "stream-episodes")
    states, close = _breaker_stream(spark, sf, root, settings.BreakerSettings())
    out = os.path.join(root, "episodes")
    jobs.drain_log(jobs.episode_stream(states, out, os.path.join(root, "checkpoint"), compact_every=3), close)
    return _episode_rows(jobs.episodes_so_far(spark, out))


@query
def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Every sliding drift window of records as they come."""
    stateful.use_state_store(spark)
    root = session.new_dir(spark, "stream-drift")
    events, log = tables.table(spark, sf, "events"), os.path.join(root, "events")
    _to_log(events, "ts", "event_id", log)
    records = tables.telemetry_of(_from_log(spark, events.schema, log), ("sent_at",))
    good = contracts.gate(norm.accepted(norm.normalize(records))).where("route = 'validated'")
    scored = drift_stream.windows(good.select("sent_at", "event_time", "event_id", *settings.FEATURES), clock="sent_at")
    written = jobs.table_stream(scored, os.path.join(root, "windows"), os.path.join(root, "checkpoint"))
    jobs.drain_log(written, lambda: _clock_on(spark, log))
    return _window_rows(spark.read.parquet(os.path.join(root, "windows")))


@query
def stream_lake(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "stream-lake")
    rows = contracts.gate(norm.accepted(norm.normalize(_raw_stream(spark, sf)))).where("route = 'validated'")
    jobs.drain(jobs.lake_stream(rows, root, os.path.join(root, "checkpoint")))
    back = jobs.committed(spark, root, "telemetry")
    return back.select(
        "event_id", "vehicle_id", text_of("timestamp").alias("timestamp"), "device_type",
        F.col("event_day").cast("string").alias("event_day"),
    )


@query
def stream_pass_ratio(spark: SparkSession, sf: str) -> DataFrame:
    root = session.new_dir(spark, "stream-ratio")
    # Eight files and two a trigger, so that several micro-batches update the same windows.
    source = os.path.join(root, "events")
    tables.table(spark, sf, "events").repartition(8, "event_id").write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    rows = contracts.gate(norm.accepted(norm.normalize(tables.telemetry_of(events))))
    out = os.path.join(root, "ratio")
    jobs.drain(jobs.pass_ratio_stream(rows, out, os.path.join(root, "checkpoint"), SLOT))
    return _shown(jobs.pass_ratio(spark, out), "window_start")
