"""Structured Streaming jobs: normalise, gate, fan out and append to the lake.

Every ``foreachBatch`` writes below ``batch_id=N`` and overwrites, so a batch that is replayed
after a failure replaces its own output. Jobs with several sinks mark a batch once all of them hold it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from convoy import session
from convoy.operators import contracts, episodes, windows
from convoy.operators import normalize as norm
from convoy.operators.breaker import ORDER
from convoy.sources import lake
from convoy.streaming import changelog

BATCH = "batch_id"


def _write(df: DataFrame, path: str, batch_id: int, by: list[str] | None = None) -> None:
    by = by or []
    (
        df.withColumn(BATCH, F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BATCH, *by)
        .parquet(path)
    )


def _commits(out: str) -> str:
    return os.path.join(out, "_commits")


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of one sink of a job, of the micro-batches that all of its sinks hold."""
    done = [int(os.path.basename(p)) for p in session.children(spark, _commits(out))]
    return spark.read.parquet(os.path.join(out, name)).where(F.col(BATCH) <= max(done, default=-1))


def _each_batch(
    df: DataFrame,
    out: str,
    checkpoint: str,
    body: Callable[[DataFrame, int], None],
    counters: dict[str, Column],
    told: Callable[[dict], list[tuple]],
    schema: str,
) -> DataStreamWriter:
    """Write every micro-batch by ``body``, then its counters, then the mark that makes it visible.

    The counters are observed while the rows pass on their way to the sinks: no pass of their own. The
    mark is one small file, so ``committed`` shows all sinks of a micro-batch or none of them; a
    micro-batch that stopped half way is written again under its number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        # Several writes read the same batch: compute it once.
        kept = batch.observe(seen, *[c.alias(n) for n, c in counters.items()]).persist()
        try:
            body(kept, batch_id)
            rows = spark.createDataFrame(told(seen.get), schema).coalesce(1)
            _write(rows, os.path.join(out, "counters"), batch_id)
            session.touch(spark, os.path.join(_commits(out), str(batch_id)))
        finally:
            kept.unpersist()

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def normalize_stream(
    raw: DataFrame, rejected_at: Column, out: str, checkpoint: str
) -> DataStreamWriter:
    """Raw records to normalised records and structural quarantine."""

    def body(batch: DataFrame, batch_id: int) -> None:
        good = norm.accepted(batch)
        _write(good, os.path.join(out, "normalized"), batch_id)
        bad = norm.structural_quarantine(batch, rejected_at)
        _write(bad, os.path.join(out, "quarantine"), batch_id)

    failed = F.col("issue") == "decode_failed"
    counters = {
        "consumed": F.count(F.lit(1)),
        "structural_failures": F.count_if(F.col("issue").isNotNull() & ~failed),
        "decode_failures": F.count_if(failed),
    }
    schema = ", ".join(f"{n} long" for n in counters)
    return _each_batch(
        norm.normalize(raw), out, checkpoint, body, counters, lambda c: [tuple(c[n] for n in counters)], schema
    )


def gate_stream(
    normalized: DataFrame, rejected_at: Column, out: str, checkpoint: str
) -> DataStreamWriter:
    """Normalised records to validated, quarantine, outcomes and counters.

    The rules are evaluated once per record. ``outcomes`` holds the narrow columns that the
    count windows read, so they need not check the rules again.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        validated = batch.where("route = 'validated'").drop("route")
        _write(validated, os.path.join(out, "validated"), batch_id)
        bad = batch.where("route = 'quarantine'").drop("route")
        records = contracts.quarantine_records(bad, rejected_at)
        _write(records, os.path.join(out, "quarantine"), batch_id)
        _write(windows.outcomes(batch), os.path.join(out, "outcomes"), batch_id)

    counters = {r: F.count_if(F.col("route") == r) for r in ("validated", "quarantine")}
    return _each_batch(
        contracts.gate(normalized), out, checkpoint, body, counters, lambda c: [(r, c[r]) for r in counters],
        "route string, records long",
    )


def lake_stream(validated: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Validated records to the partitioned telemetry table, with the batch's map counters."""

    def body(batch: DataFrame, batch_id: int) -> None:
        good = batch.where(~F.col("map_error")).drop("map_error")
        sized = good.hint("rebalance", F.col("device_type"), F.col("event_day"))
        _write(sized, os.path.join(out, "telemetry"), batch_id, ["device_type", "event_day"])

    counters = {
        "consumed": F.count(F.lit(1)),
        "appended": F.count_if(~F.col("map_error")),
        "map_errors": F.count_if("map_error"),
    }
    schema = ", ".join(f"{n} long" for n in counters)
    return _each_batch(
        lake.telemetry_rows(validated), out, checkpoint, body, counters, lambda c: [tuple(c[n] for n in counters)], schema
    )


def table_stream(df: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """An append stream to a Parquet table, exactly once through the sink's own log."""
    return (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def episode_stream(states: DataFrame, out: str, checkpoint: str, compact_every: int = 100) -> DataStreamWriter:
    """Trips and recoveries of the streaming breaker, upserted into a table of episodes.

    A micro-batch reads transitions only and writes the versions they make; ``episodes_so_far`` reads
    the table. Every ``compact_every`` micro-batches the log is made a snapshot.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        changelog.append(episodes.versions(batch), out, batch_id)
        if batch_id % compact_every == compact_every - 1:
            changelog.compact(batch.sparkSession, out, episodes.EPISODE_ROW, "incident_id", ORDER)

    return states.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def episodes_so_far(spark: SparkSession, out: str) -> DataFrame:
    return changelog.read(spark, out, episodes.EPISODE_ROW, "incident_id", ORDER).drop(*ORDER)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything available now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_log(writer: DataStreamWriter, close: Callable[[], None] | None = None) -> StreamingQuery:
    """Process all that message logs hold, then stop.

    ``close`` adds the records that only move the clock on, once everything before them is through, so
    that state held for late records is let go.
    """
    query = writer.start()
    try:
        # A source that was restarted repeats its last place first, which looks like the end.
        query.processAllAvailable()
        query.processAllAvailable()
        if close:
            close()
            query.processAllAvailable()
            query.processAllAvailable()
    finally:
        query.stop()
    return query


def pass_ratio_stream(gated: DataFrame, out: str, checkpoint: str, width: str = "5 minutes") -> DataStreamWriter:
    """Validated and quarantined records per event-time window, however late they come.

    Every micro-batch writes the windows it has changed, with their totals so far, below its own
    id; ``pass_ratio`` reads the newest state of each. State holds two numbers per window.
    """
    validated = F.count_if(F.col("route") == "validated")
    total = F.count(F.lit(1))
    ratio = (
        gated.groupBy(F.window("event_time", width).alias("w"))
        .agg(validated.alias("validated"), (total - validated).alias("quarantined"))
        .select(F.col("w.start").alias("window_start"), "validated", "quarantined")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        _write(batch, out, batch_id)

    return ratio.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(run)


def pass_ratio(spark: SparkSession, out: str) -> DataFrame:
    """The windows that ``pass_ratio_stream`` has written; counts only grow, so the largest are newest."""
    newest = F.max_by(F.struct("validated", "quarantined"), F.col("validated") + F.col("quarantined"))
    return spark.read.parquet(out).groupBy("window_start").agg(newest.alias("n")).select("window_start", "n.*")
