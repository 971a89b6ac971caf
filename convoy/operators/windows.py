"""Count windows per vehicle, rolling statistics over them, and retention ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoy.functions import coerce
from convoy.operators import scan
from convoy.settings import DriftSettings, PolicySettings, QaSettings

# Closed windows per block when one vehicle's windows are scanned in pieces.
BLOCK = 50_000


def quarantine_rate(total: Column, quarantined: Column) -> Column:
    return F.when(total > 0, quarantined / total).otherwise(0.0)


def outcomes(gated: DataFrame, *keep: str) -> DataFrame:
    """The narrow columns a count window needs from gated records, and the columns of ``keep``."""
    vehicle = F.when(F.col("vehicle_id") == "", "unknown").otherwise(
        F.coalesce("vehicle_id", F.lit("unknown"))
    )
    return gated.select(
        vehicle.alias("vehicle_id"),
        F.col("event_time"),
        coerce.record_key(gated).alias("event_id"),
        (F.col("route") == "quarantine").alias("bad"),
        *keep,
    )


def count_windows(
    rows: DataFrame, qa: QaSettings = QaSettings(), parts: int | None = None, settle: bool = True
) -> DataFrame:
    """Close a window for every ``window_size`` outcomes of a vehicle; partial ones never emit.

    The numbered rows are pre-aggregated per (vehicle, window) before their shuffle, so a hot
    vehicle moves one row per window and part. The outcomes are written to the shared folder first,
    as they are read several times; ``settle`` is false for rows that are stored already.
    """
    order = ["event_time", "event_id"]
    rows = rows.select("vehicle_id", *order, "bad")
    numbered = scan.keyed_sequence(rows, ["vehicle_id"], order, parts=parts, settle=settle)
    size = qa.window_size
    rate = quarantine_rate(F.col("total"), F.col("quarantined"))
    return (
        numbered.groupBy("vehicle_id", F.expr(f"seq div {size}").alias("window_no"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("bad").alias("quarantined"),
            F.max("event_time").alias("window_end"),
        )
        .where(F.col("total") == size)
        .select(
            "vehicle_id",
            "window_no",
            F.lit(size).alias("window_size"),
            "total",
            "quarantined",
            F.round(rate, 6).alias("quarantine_rate"),
            F.lit(qa.rate_threshold).alias("threshold"),
            # The unrounded rate decides.
            (rate > qa.rate_threshold).alias("exceeded"),
            "window_end",
            F.lit("qa_quarantine_rate").alias("type"),
        )
    )


def rolling_quality(
    windows: DataFrame, policy: PolicySettings = PolicySettings(), block: int = BLOCK
) -> DataFrame:
    """Rolling mean rate over the last batches, batches seen, and the exceeded streak.

    ``window_no`` is dense per vehicle, so blocks of it with a small overlap give the rolling
    mean, and the streak is the distance to the last good window, carried across blocks.
    """
    reach = policy.window_batches - 1
    haloed, group = scan.with_halo(windows, ["vehicle_id"], "window_no", reach, block)
    ordered = Window.partitionBy(*group).orderBy("window_no")
    # Oldest first, so that the floating-point sum equals a left-to-right one.
    total = F.lit(0.0)
    for back in range(reach, -1, -1):
        total = total + F.coalesce(F.lag("quarantine_rate", back).over(ordered), F.lit(0.0))
    seen = F.least(F.col("window_no") + 1, F.lit(policy.window_batches))
    rolled = (
        haloed.withColumn("_sum", total)
        .where("_own")
        .withColumn("batch_count", seen)
        .withColumn("rolling_rate", F.col("_sum") / F.col("batch_count"))
        .drop("_sum", "_own")
        .withColumnRenamed("_block", scan.PART)
    )
    good = F.when(~F.col("exceeded"), F.col("window_no"))
    last_good = scan.running(
        rolled, ["vehicle_id"], ["window_no"], maxima={"_last_good": good}
    ).drop(scan.PART)
    streak = F.col("window_no") - F.coalesce("_last_good", F.lit(-1))
    return last_good.withColumn("streak", streak).drop("_last_good")


def drift_sequence(rows: DataFrame, drift: DriftSettings = DriftSettings(), settle: bool = True) -> DataFrame:
    """Number the rows fleet-wide; ``phase`` is warmup, baseline or live. ``settle`` as in ``count_windows``."""
    rows = rows.withColumn("event_id", coerce.record_key(rows))
    numbered = scan.keyed_sequence(rows, [], ["event_time", "event_id"], settle=settle)
    start = drift.warmup + drift.baseline
    return numbered.withColumn(
        "phase",
        F.when(F.col("seq") < drift.warmup, "warmup")
        .when(F.col("seq") < start, "baseline")
        .otherwise("live"),
    ).withColumn("pos", F.col("seq") - start)


def baseline_staleness(numbered: DataFrame) -> DataFrame:
    """Per live row, seconds since the baseline was frozen; 0 before that."""
    frozen = numbered.where("phase = 'baseline'").agg(F.max("event_time")).scalar()
    age = F.unix_micros("event_time") - F.unix_micros(frozen)
    return numbered.withColumn(
        "staleness_seconds", F.when(F.col("phase") == "live", age / 1e6).otherwise(0.0)
    )


def every_nth(window_count: Column, every: int = 30, size: int = 50) -> Column:
    """True on the last slide of each ``every``-th tumbling window."""
    return (window_count > 0) & (F.pmod(window_count, F.lit(max(size, 1) * max(every, 1))) == 0)


def split_retention(df: DataFrame, newest: list[Column], keep: int) -> DataFrame:
    """Mark the newest ``keep`` rows as kept and the rest as expired.

    Only the ``keep`` kept rows are collected to compare against: a bounded sort, no global
    window. ``keep`` of 0 or less keeps everything.
    """
    if keep <= 0:
        return df.withColumn("expired", F.lit(False))
    order = F.struct(*newest)
    oldest_kept = (
        df.select(order.alias("_at")).orderBy(F.col("_at").desc()).limit(keep).agg(F.min("_at"))
    )
    return df.withColumn("expired", order < oldest_kept.scalar())
