"""Service levels: windowed ratios and rates, sustained alerts, and the breach report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.operators import scan
from convoy.operators.breaker import OPEN
from convoy.settings import SloSettings


@dataclass(frozen=True)
class Alert:
    name: str
    severity: str
    hold_seconds: int


# --- fixed values: alert rules and how long a breach must hold --------------------------
ALERTS = {
    "qa_pass_ratio": Alert("QAPassRateSLOBreach", "warning", 120),
    "drift_score_avg": Alert("DriftScoreElevated", "warning", 180),
    "breakers_open": Alert("CircuitBreakerOpen", "critical", 60),
    "breaker_trip_rate": Alert("EscalationStorm", "critical", 120),
}
# Upper bounds of latency buckets, in seconds: the metrics client's defaults.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# ---------------------------------------------------------------------------------------


def breached(metric: Column, value: Column, slo: SloSettings = SloSettings()) -> Column:
    return (
        F.when(metric == "qa_pass_ratio", value < slo.pass_ratio)
        .when(metric == "drift_score_avg", value > slo.drift_score)
        .when(metric == "breakers_open", value > slo.open_breakers)
        .when(metric == "breaker_trip_rate", value > slo.trip_rate)
        .otherwise(False)
    )


def pass_ratio(gated: DataFrame, width: str = "5 minutes", at: str = "event_time") -> DataFrame:
    validated = F.count_if(F.col("route") == "validated")
    total = F.count(F.lit(1))
    return (
        gated.groupBy(F.window(at, width).alias("w"))
        .agg(validated.alias("validated"), (total - validated).alias("quarantined"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "validated",
            "quarantined",
            (F.col("validated") / F.greatest(F.col("validated") + F.col("quarantined"), F.lit(1e-9))).alias(
                "pass_ratio"
            ),
        )
    )


def event_rate(
    df: DataFrame, width: str, at: str = "event_time", by: list[str] | None = None
) -> DataFrame:
    """Events per second in each time window, optionally per key."""
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return (
        df.groupBy(F.window(at, width).alias("w"), *(by or []))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *(by or []),
            "events",
            (F.col("events") / seconds).alias("per_second"),
        )
    )


def throughput(df: DataFrame, width: str = "2 seconds", last: int = 40) -> DataFrame:
    """The newest points of the live throughput curve."""
    return event_rate(df, width).orderBy(F.desc("window_start")).limit(last)


def latency_quantiles(df: DataFrame, value: str, width: str, at: str = "event_time") -> DataFrame:
    """Exact p50 and p95 of a latency per time window."""
    slots = df.select(F.window(at, width)["start"].alias("window_start"), value)
    return scan.exact_quantiles(slots, ["window_start"], value, {"p50": 0.5, "p95": 0.95})


def histogram(df: DataFrame, value: str, keys: list[str], bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative bucket counts per key: ``buckets[i]`` values are at most ``bounds[i]``, ``total`` there are.

    One row per key leaves a task, whatever the number of values, and histograms of parts, windows or
    days add up (``merged``). Nulls and NaN are not counted.
    """
    seen = F.col(value)
    known = df.where(seen.isNotNull() & ~F.isnan(seen.cast("double")))
    counts = [F.count_if(seen <= F.lit(b)).alias(f"_le{i}") for i, b in enumerate(bounds)]
    return known.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total")).select(
        *keys, F.array(*[F.col(f"_le{i}") for i in range(len(bounds))]).alias("buckets"), "total"
    )


def merged(histograms: DataFrame, keys: list[str], n_bounds: int = len(LATENCY_BOUNDS)) -> DataFrame:
    """Histograms with the same bounds added up per key."""
    sums = [F.sum(F.col("buckets")[i]).alias(f"_le{i}") for i in range(n_bounds)]
    return histograms.groupBy(*keys).agg(*sums, F.sum("total").alias("total")).select(
        *keys, F.array(*[F.col(f"_le{i}") for i in range(n_bounds)]).alias("buckets"), "total"
    )


def bucket_quantile(p: float, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> Column:
    """The quantile of a histogram, by a straight line inside the bucket that its rank falls in.

    The first bucket begins at 0, or at its own bound where that is not above 0. A rank beyond the
    last bound gives that bound. The exact quantile lies in the same bucket.
    """
    rank = F.col("total") * F.lit(p)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        upper = float(bounds[i])
        lower = float(bounds[i - 1]) if i else min(0.0, upper)
        if not i and upper <= 0:
            lower = upper
        before = F.col("buckets")[i - 1] if i else F.lit(0)
        here = F.col("buckets")[i] - before
        inside = F.when(here > 0, F.lit(lower) + F.lit(upper - lower) * (rank - before) / here).otherwise(F.lit(upper))
        out = F.when(F.col("buckets")[i] >= rank, inside).otherwise(out)
    return F.when(F.col("total") > 0, out)


def bucket_latency(df: DataFrame, value: str, width: str, at: str = "event_time") -> DataFrame:
    """p50 and p95 of a latency per time window from bucket counts: no sort, and no row moves."""
    slots = df.select(F.window(at, width)["start"].alias("window_start"), value)
    counted = histogram(slots, value, ["window_start"])
    return counted.select(
        "window_start", "total", bucket_quantile(0.5).alias("p50"), bucket_quantile(0.95).alias("p95")
    )


def drift_score_average(scored: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Mean score over the features at each analysed window."""
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(f"{name}_score")
    return scored.select("window_no", "window_end", (total / len(names)).alias("drift_score_avg"))


def open_breakers(timeline: DataFrame, width: str) -> DataFrame:
    """Open breakers at the end of each time window, from the changes inside the windows."""
    change = (F.col("state") == OPEN).cast("long") - (F.col("prior_state") == OPEN).cast("long")
    changes = (
        timeline.groupBy(F.window("event_time", width).alias("w"))
        .agg(F.sum(change).alias("_change"), F.count_if("tripped").alias("trips"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "_change", "trips")
    )
    tagged = scan.split_in_order(changes, [], ["window_start"], settle=True)
    summed = scan.running(tagged, [], ["window_start"], sums={"breakers_open": F.col("_change")})
    seconds = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1e6
    return summed.select(
        "window_start",
        "window_end",
        "breakers_open",
        "trips",
        (F.col("trips") / seconds).alias("breaker_trip_rate"),
    )


def samples(metric: str, df: DataFrame, at: str, value: str, slo: SloSettings = SloSettings()) -> DataFrame:
    name, level = F.lit(metric), F.col(value).cast("double")
    return df.select(
        name.alias("metric"),
        F.col(at).alias("at"),
        level.alias("value"),
        breached(name, level, slo).alias("breached"),
    )


def sustained_alerts(sampled: DataFrame, hold: dict[str, int] | None = None) -> DataFrame:
    """Alerts whose breach held for the rule's time.

    Consecutive breached samples share the count of good samples before them; each run of
    them is one aggregate row.
    """
    tagged = scan.split_in_order(sampled, ["metric"], ["at"], settle=True)
    good = (~F.col("breached")).cast("long")
    runs = scan.running(tagged, ["metric"], ["at"], sums={"_run": good})
    held = F.unix_micros("last_breached") - F.unix_micros("active_since")
    needed, name, severity = F.lit(None).cast("long"), F.lit(None), F.lit(None)
    for metric, alert in ALERTS.items():
        seconds = (hold or {}).get(metric, alert.hold_seconds)
        is_it = F.col("metric") == metric
        needed = F.when(is_it, F.lit(seconds).cast("long")).otherwise(needed)
        name = F.when(is_it, alert.name).otherwise(name)
        severity = F.when(is_it, alert.severity).otherwise(severity)
    return (
        runs.where("breached")
        .groupBy("metric", "_run")
        .agg(
            F.min("at").alias("active_since"),
            F.max("at").alias("last_breached"),
            F.count(F.lit(1)).alias("samples"),
            F.max_by("value", "at").alias("value"),
        )
        .where(held >= needed * 1_000_000)
        .select(
            name.alias("alert"), severity.alias("severity"), "active_since", "last_breached", "samples", "value"
        )
    )


def report(latest: DataFrame, slo: SloSettings = SloSettings()) -> DataFrame:
    """One line per breached level of (metric, value), or one CLEAR line."""
    v = F.col("value")
    line = (
        F.when(
            F.col("metric") == "qa_pass_ratio",
            F.format_string(f"QA pass ratio %.4f below {slo.pass_ratio} SLO", v),
        )
        .when(
            F.col("metric") == "drift_score_avg",
            F.format_string(f"Drift score %.4f exceeds {slo.drift_score} warning threshold", v),
        )
        .when(
            F.col("metric") == "breakers_open",
            F.format_string("%d circuit breaker(s) OPEN", v.cast("long")),
        )
        .otherwise(F.format_string("Escalation storm: trip rate %.4f/s", v))
    )
    bad = latest.where(breached(F.col("metric"), v, slo)).select(
        F.lit("BREACH").alias("status"), "metric", line.alias("line")
    )
    count = bad.agg(F.count(F.lit(1))).scalar()
    clear = (
        latest.sparkSession.range(1)
        .where(count == 0)
        .select(
            F.lit("CLEAR").alias("status"),
            F.lit("all").alias("metric"),
            F.lit("no SLO / drift / breaker breaches detected").alias("line"),
        )
    )
    return bad.unionByName(clear)
