"""Retraining decisions from drift signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.settings import RetrainSettings


def latest(signals: DataFrame) -> DataFrame:
    """The newest signal, by a single aggregate."""
    row = F.struct(*[c for c in signals.columns])
    return signals.agg(F.max_by(row, "generated_at").alias("s")).where("s is not null").select("s.*")


def decide(signals: DataFrame, cfg: RetrainSettings = RetrainSettings()) -> DataFrame:
    """Whether each signal calls for retraining, and why.

    A missing maximum or count is taken from the scores.
    """
    scores = F.map_values("feature_scores")
    top = F.coalesce("max_drift_score", F.array_max(scores), F.lit(0.0))
    count = F.coalesce(
        F.col("drifted_feature_count").cast("long"),
        F.size(F.filter(scores, lambda v: v > 0.0)).cast("long"),
        F.lit(0),
    )
    by_score, by_count = top >= cfg.max_score, count >= cfg.min_features
    return signals.withColumns(
        {
            "max_drift_score": top,
            "drifted_feature_count": count,
            "should_retrain": by_score | by_count,
            "reason": F.when(by_score & by_count, "score_and_feature_count")
            .when(by_score, "max_drift_score")
            .when(by_count, "drifted_feature_count")
            .otherwise("below_threshold"),
        }
    )


def decide_latest(signals: DataFrame, cfg: RetrainSettings = RetrainSettings()) -> DataFrame:
    """One decision from the newest signal, or the no-signal decision when there is none."""
    decided = decide(latest(signals), cfg).select(
        "should_retrain", "reason", "max_drift_score", "drifted_feature_count", "window_size",
        "source_report",
    )
    one = signals.sparkSession.range(1).select(F.lit(1).alias("_one"))
    filled = one.join(decided.withColumn("_one", F.lit(1)), "_one", "left")
    return filled.select(
        F.coalesce("should_retrain", F.lit(False)).alias("should_retrain"),
        F.coalesce("reason", F.lit("no_evidently_signal")).alias("reason"),
        F.coalesce("max_drift_score", F.lit(0.0)).alias("max_drift_score"),
        F.coalesce("drifted_feature_count", F.lit(0)).alias("drifted_feature_count"),
        F.coalesce("window_size", F.lit(0)).alias("window_size"),
        "source_report",
    )


def runs(decisions: DataFrame) -> DataFrame:
    """Rows of the runs table for the decisions that trigger retraining."""
    key = F.concat(F.lit("retrain|"), F.unix_micros("generated_at").cast("string"))
    return decisions.where("should_retrain").select(
        F.concat(F.lit("retrain-"), F.substring(F.sha2(key, 256), 1, 12)).alias("trigger_id"),
        F.lit("retraining_triggered").alias("event_type"),
        F.col("generated_at").alias("triggered_at"),
        F.col("reason").alias("trigger_reason"),
        "source_report",
        "window_size",
        "max_drift_score",
        "drifted_feature_count",
        "feature_scores",
    )
