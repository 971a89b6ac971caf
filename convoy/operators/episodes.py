"""Incident episodes, operator actions, and incident lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.functions import coerce
from convoy.functions import policy as rules
from convoy.operators import scan
from convoy.operators.breaker import ORDER
from convoy.settings import PolicySettings

MAX_LISTED = 50

# Actions sort after the breaker events of the same instant.
ACTION_KIND = 2


def incident_id(vehicle: Column, first_trip: Column) -> Column:
    """Stable id of an episode: its vehicle and the instant of its first trip."""
    nanos = F.concat(F.unix_micros(first_trip).cast("string"), F.lit("000"))
    return F.concat(F.lit("esc_"), vehicle, F.lit("_"), nanos)


def _effective_resolves(tokens: DataFrame, actions: DataFrame) -> DataFrame:
    """Manual resolves that close a still open episode.

    The action names its episode by vehicle and first trip. It takes effect when that trip
    exists and no recovery lies between the two; repeats change nothing.
    """
    wanted = (
        actions.where("action = 'resolve'")
        .select(
            F.regexp_extract("incident_id", "^esc_(.*)_([0-9]+)$", 1).alias("vehicle_id"),
            F.timestamp_micros(
                F.regexp_extract("incident_id", "^esc_(.*)_([0-9]+)000$", 2).try_cast("long")
            ).alias("opened"),
            "action_at",
        )
        .groupBy("vehicle_id", "opened")
        .agg(F.min("action_at").alias("event_time"))
        .where("event_time >= opened")
    )
    trips = tokens.where("tripped").select("vehicle_id", F.col("event_time").alias("opened"))
    known = wanted.join(trips.distinct(), ["vehicle_id", "opened"], "left_semi")
    asks = known.select(
        "vehicle_id",
        "event_time",
        F.lit(ACTION_KIND).alias("kind"),
        F.unix_micros("opened").cast("string").alias("ref"),
        F.lit(None).cast("timestamp").alias("recovery"),
        F.col("opened"),
    )
    recoveries = tokens.where("recovered").select(
        "vehicle_id",
        *ORDER,
        F.col("event_time").alias("recovery"),
        F.lit(None).cast("timestamp").alias("opened"),
    )
    tagged = scan.split_in_order(asks.unionByName(recoveries), ["vehicle_id"], ORDER, settle=True)
    seen = scan.running(tagged, ["vehicle_id"], ORDER, lasts={"_last": F.col("recovery")})
    live = F.col("opened").isNotNull() & (F.col("_last").isNull() | (F.col("_last") <= F.col("opened")))
    return seen.where(live).select("vehicle_id", *ORDER)


def episodes(timeline: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """One row per episode: its first trip opens it, later trips are retrips, and a recovery
    or a manual resolve closes it.

    Trips with the same number of closings before them belong together, so numbering needs a
    running count only and the rest is one partial aggregation.
    """
    tokens = timeline.where(F.col("tripped") | F.col("recovered")).drop(scan.PART)
    marked = tokens.withColumn("closing", F.when(F.col("recovered"), "breaker_recovered"))
    if actions is not None:
        manual = _effective_resolves(tokens, actions).withColumns(
            {"tripped": F.lit(False), "closing": F.lit("manual")}
        )
        marked = marked.unionByName(manual, allowMissingColumns=True)
    tagged = scan.split_in_order(marked, ["vehicle_id"], ORDER, settle=True)
    closed = F.col("closing").isNotNull().cast("long")
    numbered = scan.running(tagged, ["vehicle_id"], ORDER, sums={"_closings": closed})
    at = F.struct(*ORDER)
    trip = F.col("tripped")
    latest = ["severity", "route", "reasons", "rolling_rate", "batch_count", "streak", "drift_count"]
    grouped = (
        numbered.groupBy("vehicle_id", (F.col("_closings") - closed).alias("_episode"))
        .agg(
            F.min(F.when(trip, F.col("event_time"))).alias("first_trip"),
            F.max(F.when(trip, F.col("event_time"))).alias("last_trip"),
            (F.count_if(trip) - 1).alias("retrip_count"),
            F.max_by(F.struct(*latest), F.when(trip, at)).alias("_last"),
            F.max(F.when(closed == 1, F.col("event_time"))).alias("resolved_at"),
            F.max("closing").alias("resolve_reason"),
        )
        .where("first_trip is not null")
    )
    is_open = F.col("resolved_at").isNull()
    table = grouped.select(
        incident_id(F.col("vehicle_id"), F.col("first_trip")).alias("incident_id"),
        "vehicle_id",
        *[F.col(f"_last.{c}").alias(c) for c in latest],
        F.when(is_open, "open").otherwise("resolved").alias("status"),
        "first_trip",
        "last_trip",
        "resolved_at",
        "resolve_reason",
        "retrip_count",
        is_open.alias("open"),
    ).withColumn(
        "summary",
        rules.incident_summary(F.col("vehicle_id"), F.col("reasons"), F.col("retrip_count")),
    )
    return table if actions is None else _acknowledged(table, actions)


# A version of an episode row, and what orders the versions of one episode.
EPISODE_ROW = (
    "incident_id string, vehicle_id string, severity string, route string, reasons array<string>, rolling_rate double, "
    "batch_count bigint, streak bigint, drift_count bigint, status string, first_trip timestamp, last_trip timestamp, "
    "resolved_at timestamp, resolve_reason string, retrip_count bigint, open boolean, summary string, "
    "event_time timestamp, kind int, ref string"
)


def versions(states: DataFrame, policy: PolicySettings = PolicySettings()) -> DataFrame:
    """One whole episode row per trip and recovery, as the episode stands after it.

    ``states`` comes from the streaming breaker, whose transitions carry their episode. The decision of
    an episode is that of its last trip, worked out by the same expressions as everywhere.
    """
    changes = states.where(F.col("tripped") | F.col("recovered"))
    at = [F.col(c).alias(f"_{c}") for c in ORDER]
    last = changes.select(
        "vehicle_id",
        *at,
        "recovered",
        F.timestamp_micros("episode_first_us").alias("first_trip"),
        F.timestamp_micros("episode_last_us").alias("event_time"),
        F.col("episode_retrips").alias("retrip_count"),
        F.col("last_rate").alias("rolling_rate"),
        F.col("last_batches").alias("batch_count"),
        F.col("last_streak").alias("streak"),
        F.col("last_drift").alias("drift_count"),
    )
    closed = F.col("recovered")
    return rules.decide(last, policy).select(
        incident_id(F.col("vehicle_id"), F.col("first_trip")).alias("incident_id"),
        "vehicle_id", "severity", "route", "reasons", "rolling_rate", "batch_count", "streak", "drift_count",
        F.when(closed, "resolved").otherwise("open").alias("status"),
        "first_trip",
        F.col("event_time").alias("last_trip"),
        F.when(closed, F.col("_event_time")).alias("resolved_at"),
        F.when(closed, "breaker_recovered").alias("resolve_reason"),
        "retrip_count",
        (~closed).alias("open"),
        rules.incident_summary(F.col("vehicle_id"), F.col("reasons"), F.col("retrip_count")).alias("summary"),
        *[F.col(f"_{c}").alias(c) for c in ORDER],
    )


def _acknowledged(table: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply acknowledgements; a retrip after one puts the episode back to open.

    The summary is one text that holds every standing note, so the notes of an episode do
    come together; they are typed by operators.
    """
    acks = actions.where("action = 'acknowledge'").select("incident_id", "action_at", "note")
    spans = table.select("incident_id", "last_trip", "resolved_at")
    standing = (
        acks.join(spans, "incident_id")
        .where(
            (F.col("action_at") >= F.col("last_trip"))
            & (F.col("resolved_at").isNull() | (F.col("action_at") < F.col("resolved_at")))
        )
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct("action_at", "note"))).alias("_acks"))
    )
    notes = F.filter(F.col("_acks")["note"], lambda n: F.coalesce(n != "", F.lit(False)))
    text = F.concat(
        F.col("summary"),
        F.array_join(F.transform(notes, lambda n: F.concat(F.lit(" | ack: "), n)), ""),
    )
    taken = F.col("_acks").isNotNull()
    return (
        table.join(standing, "incident_id", "left")
        .withColumns(
            {
                "status": F.when(taken & F.col("open"), "acknowledged").otherwise(F.col("status")),
                "summary": F.when(taken, text).otherwise(F.col("summary")),
            }
        )
        .drop("_acks")
    )


def action_outcomes(table: DataFrame, actions: DataFrame) -> DataFrame:
    """What each operator action did: ok, unchanged, or the error it raised."""
    spans = table.select("incident_id", "resolved_at", "resolve_reason")
    resolved = F.col("resolved_at").isNotNull() & (F.col("resolved_at") < F.col("action_at"))
    outcome = (
        F.when(F.col("_known").isNull(), "not_found")
        .when((F.col("action") == "acknowledge") & resolved, "already_resolved")
        .when((F.col("action") == "resolve") & resolved, "unchanged")
        .otherwise("ok")
    )
    return (
        actions.join(spans.withColumn("_known", F.lit(True)), "incident_id", "left")
        .withColumn("outcome", outcome)
        .select("incident_id", "action", "action_at", "outcome")
    )


def with_status(table: DataFrame, status: str = "") -> DataFrame:
    """Filter by status: open, resolved, any exact status, or all when empty."""
    if status == "open":
        return table.where(F.col("open") & (F.col("status") == "open"))
    if status == "resolved":
        return table.where(~F.col("open") | (F.col("status") == "resolved"))
    return table.where(F.col("status") == status) if status else table


def for_vehicle(
    table: DataFrame, vehicle_id: str, limit: int = MAX_LISTED
) -> tuple[DataFrame, DataFrame]:
    """The vehicle's incidents (any case, the first ``limit`` listed) and their full count."""
    wanted = vehicle_id.strip().upper()
    mine = table.where(F.upper("vehicle_id") == wanted) if wanted else table
    return mine.orderBy("first_trip", "incident_id").limit(limit), mine.agg(F.count(F.lit(1)).alias("count"))


def summaries(table: DataFrame) -> DataFrame:
    """Incident rows in the contract's symbols."""
    return table.select(
        "incident_id",
        "vehicle_id",
        coerce.incident_severity(F.col("severity")).alias("severity"),
        coerce.incident_status(F.col("status")).alias("status"),
        F.col("summary").alias("reason"),
    )


def history(archived: DataFrame, live: DataFrame) -> DataFrame:
    """Archived and live incidents in one table; columns either side lacks are null."""
    return archived.unionByName(live, allowMissingColumns=True)


def notifications(table: DataFrame, product: str, channel: str, routing_key: str) -> DataFrame:
    """One row per episode and delivery channel, with that channel's payload."""
    retrips, vehicle = F.col("retrip_count"), F.col("vehicle_id")
    chat = F.struct(
        F.lit(channel).alias("channel"),
        rules.chat_text(
            product, vehicle, F.col("severity"), F.col("reasons"), retrips, F.col("incident_id")
        ).alias("text"),
    )
    details = F.struct(
        "vehicle_id",
        "incident_id",
        "reasons",
        "route",
        F.struct("rolling_rate", "batch_count", "streak", "drift_count").alias("metrics"),
        "retrip_count",
        F.col("last_trip").alias("last_updated_at"),
    )
    page = F.struct(
        F.lit(routing_key).alias("routing_key"),
        F.lit("trigger").alias("event_action"),
        F.col("incident_id").alias("dedup_key"),
        F.struct(
            rules.page_summary(F.col("summary"), retrips).alias("summary"),
            rules.page_severity(F.col("severity")).alias("severity"),
            F.lit("incident-engine").alias("source"),
            vehicle.alias("component"),
            details.alias("custom_details"),
        ).alias("payload"),
    )
    one = table.withColumn("target", F.explode(rules.channels(F.col("route"))))
    return one.select(
        "incident_id",
        "target",
        F.when(F.col("target") == "slack", chat).alias("slack"),
        F.when(F.col("target") == "pagerduty", page).alias("pagerduty"),
    )
