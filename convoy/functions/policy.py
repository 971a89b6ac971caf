"""Trip policy, routing and notification payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoy.settings import PolicySettings

FLEET = "fleet"

# --- fixed values: business hours in UTC, Monday to Friday ------------------------------
OPENING_HOUR, CLOSING_HOUR = 13, 21
# ---------------------------------------------------------------------------------------


def incident_drift_count(observed: Column, drifted_features: Column) -> Column:
    """The larger of the reported count and the number of named features."""
    named = F.when(drifted_features.isNotNull(), F.size(drifted_features)).otherwise(0)
    return F.greatest(observed.cast("long"), named.cast("long"))


def incident_vehicle(vehicle: Column) -> Column:
    return F.when(vehicle == "", FLEET).otherwise(F.coalesce(vehicle, F.lit(FLEET)))


def trips(
    rate: Column, batches: Column, streak: Column, drift: Column, policy: PolicySettings
) -> dict[str, Column]:
    """The three trip conditions. The streak does not wait for a full window."""
    return {
        "trip_quarantine": (batches >= policy.window_batches) & (rate > policy.rate_threshold),
        "trip_drift": drift >= policy.drift_min_features,
        "trip_consecutive": streak >= policy.consecutive_max,
    }


def reasons(
    rate: Column, batches: Column, streak: Column, drift: Column, policy: PolicySettings
) -> Column:
    """The set of reasons, in alphabetical order."""
    hit = trips(rate, batches, streak, drift, policy)
    consecutive = F.format_string(
        f"consecutive_qa_failures: count=%d threshold={policy.consecutive_max}", streak
    )
    multi = F.format_string(
        f"multi_feature_drift: count=%d threshold={policy.drift_min_features}", drift
    )
    exceeded = F.format_string(
        f"qa_quarantine_rate_exceeded: rolling=%.4f threshold={policy.rate_threshold:.4f} batches=%d",
        rate,
        batches,
    )
    return F.array_compact(
        F.array(
            F.when(hit["trip_consecutive"], consecutive),
            F.when(hit["trip_drift"], multi),
            F.when(hit["trip_quarantine"], exceeded),
        )
    )


def channel_route(at: Column, rate: Column, drift: Column, policy: PolicySettings) -> Column:
    """Paging in business hours, both channels on a dual signal, chat otherwise."""
    hours = (
        F.weekday(at).between(0, 4)
        & (F.hour(at) >= OPENING_HOUR)
        & (F.hour(at) < CLOSING_HOUR)
    )
    dual = (drift >= policy.drift_min_features) & (rate > policy.rate_threshold)
    return F.when(hours & dual, "both").when(hours, "pagerduty").otherwise("slack")


def decide(df, policy: PolicySettings = PolicySettings(), at: str = "event_time"):
    """Add the policy decision to rows of (rolling_rate, batch_count, streak, drift_count)."""
    args = [F.col(c) for c in ("rolling_rate", "batch_count", "streak", "drift_count")]
    hit = trips(*args, policy)
    trip = hit["trip_quarantine"] | hit["trip_drift"] | hit["trip_consecutive"]
    return df.withColumns(hit).withColumns(
        {
            "trip": trip,
            "severity": F.when(trip, "critical").otherwise("warning"),
            "reasons": reasons(*args, policy),
            "route": channel_route(F.col(at), args[0], args[3], policy),
        }
    )


def reason_list(names: Column) -> Column:
    """Reasons as one bracketed text, or the fallback when there are none."""
    shown = F.concat(F.lit("["), F.array_join(names, " "), F.lit("]"))
    return F.when(F.size(names) > 0, shown).otherwise("policy trip")


def incident_summary(vehicle: Column, names: Column, retrips: Column) -> Column:
    first = F.concat(F.lit("Circuit breaker tripped for "), vehicle, F.lit(": "))
    again = F.concat(
        F.lit("Circuit breaker still open for "),
        vehicle,
        F.lit(" (retrip "),
        retrips.cast("string"),
        F.lit("): "),
    )
    return F.concat(F.when(retrips > 0, again).otherwise(first), reason_list(names))


def chat_text(
    product: str, vehicle: Column, severity: Column, names: Column, retrips: Column, incident: Column
) -> Column:
    joined = F.array_join(names, "; ")
    siren = f":rotating_light: *{product} Incident*"
    fresh = F.concat(
        F.lit(f"{siren} | vehicle `"), vehicle, F.lit("` | "), severity, F.lit(" | reasons="), joined
    )
    updated = F.concat(
        F.lit("[UPDATED x"),
        retrips.cast("string"),
        F.lit(f"] {siren} (ongoing) | vehicle `"),
        vehicle,
        F.lit("` | "),
        severity,
        F.lit(" | reasons="),
        joined,
        F.lit(" | id=`"),
        incident,
        F.lit("`"),
    )
    return F.when(retrips > 0, updated).otherwise(fresh)


def page_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "warning", "info"), low).otherwise("error")


def page_summary(summary: Column, retrips: Column) -> Column:
    prefix = F.concat(F.lit("[UPDATED x"), retrips.cast("string"), F.lit("] "))
    return F.when(retrips > 0, F.concat(prefix, summary)).otherwise(summary)


def channels(route: Column) -> Column:
    """The channels a route delivers to."""
    return (
        F.when(route == "pagerduty", F.array(F.lit("pagerduty")))
        .when(route == "both", F.array(F.lit("slack"), F.lit("pagerduty")))
        .otherwise(F.array(F.lit("slack")))
    )
