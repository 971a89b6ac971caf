"""Partitioned lake tables: mapping, append, publication and reading back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy import session, settings
from convoy.functions import coerce

_TELEMETRY_TYPES = {
    f: "double" if f in settings.NUMERIC_FIELDS else "string" for f in settings.TELEMETRY_FIELDS
}


def event_instant(df: DataFrame, name: str = "timestamp") -> Column:
    """The event time, from a timestamp, ISO text, or epoch seconds or milliseconds."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp")
    return coerce.any_instant(F.col(name).cast("string"))


def telemetry_rows(validated: DataFrame) -> DataFrame:
    """The twelve typed lake columns and the partition day.

    ``map_error`` marks rows that lack a required field; they are counted, not written.
    """
    typed = {
        f: F.col(f).cast("string") if t == "string" else coerce.numeric_field(validated, f)
        for f, t in _TELEMETRY_TYPES.items()
    }
    # Normalised records already carry the parsed instant.
    parsed = "event_time" in validated.columns
    typed["timestamp"] = F.col("event_time") if parsed else event_instant(validated)
    missing = F.lit(False)
    for column in typed.values():
        missing = missing | column.isNull()
    keep = [c for c in ("event_id",) if c in validated.columns]
    rows = validated.select(*keep, *[c.alias(f) for f, c in typed.items()], missing.alias("map_error"))
    return rows.withColumns(
        {
            "device_type": F.when(~coerce.is_blank(F.col("device_type")), F.col("device_type")).otherwise(
                "DEVICE_TYPE_UNSPECIFIED"
            ),
            "event_day": F.to_date("timestamp"),
        }
    )


def quarantine_rows(records: DataFrame) -> DataFrame:
    """Quarantine records with nested parts as JSON text, and the partition day."""
    as_text = F.to_json("violations")
    keep = [c for c in ("event_id",) if c in records.columns]
    return records.select(
        *keep,
        F.coalesce(F.col("rejected_at"), F.current_timestamp()).alias("rejected_at"),
        F.coalesce("source_topic", F.lit("")).alias("source_topic"),
        "vehicle_id",
        "field",
        "rule",
        "reason",
        F.coalesce(as_text, F.lit("[]")).alias("violations_json"),
        F.coalesce("raw_payload", F.lit("{}")).alias("raw_payload_json"),
    ).withColumn("reject_day", F.to_date("rejected_at"))


def map_counters(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(~F.col("map_error")).alias("appended"),
        F.count_if("map_error").alias("map_errors"),
    )


def _sized(df: DataFrame, by: list[str]) -> DataFrame:
    """Gather rows of a partition value into files of the advisory size.

    The rebalance hint lets the runtime split a large value over many files and merge small
    ones; a plain repartition would send a hot value to one task.
    """
    return df.hint("rebalance", *[F.col(c) for c in by])


def append(df: DataFrame, path: str, by: list[str]) -> None:
    _sized(df, by).write.mode("append").partitionBy(*by).parquet(path)


def append_telemetry(rows: DataFrame, path: str) -> None:
    append(rows.where(~F.col("map_error")).drop("map_error"), path, ["device_type", "event_day"])


def append_quarantine(rows: DataFrame, path: str) -> None:
    append(rows, path, ["reject_day"])


def append_frames(rows: DataFrame, path: str) -> None:
    """Ground-truth and sensor rows go by scenario type and day, calibration by day."""
    by = [c for c in ("scenario_type",) if c in rows.columns] + ["event_day"]
    append(rows.withColumn("event_day", F.to_date("timestamp")), path, by)


def commit(df: DataFrame, path: str, commit_id: int, by: list[str] | None = None) -> None:
    """Write one numbered commit. Writing the same number again replaces it.

    A mark of its own makes it visible once all its files are there. While a commit is being written
    again it is hidden, so no reader sees half of the old and half of the new files.
    """
    spark, by = df.sparkSession, by or []
    session.delete(spark, _mark(path, commit_id))
    session.delete(spark, os.path.join(path, f"commit_id={commit_id}"))
    out = df.withColumn("commit_id", F.lit(commit_id))
    (
        (_sized(out, by) if by else out)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("commit_id", *by)
        .parquet(path)
    )
    session.touch(spark, _mark(path, commit_id))


def _mark(path: str, commit_id: int) -> str:
    return os.path.join(path, "_commits", str(commit_id))


def as_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table as of a commit: the finished commits up to it, others are pruned as partitions."""
    marks = [int(os.path.basename(p)) for p in session.children(spark, os.path.join(path, "_commits"))]
    return spark.read.parquet(path).where(F.col("commit_id").isin([n for n in marks if n <= version]))


def publish_batch(valid: DataFrame, path: str, dt: str, execution_id: str) -> None:
    """Publish a batch under its date and execution; a repeat replaces its own files, with none if it is empty."""
    session.delete(valid.sparkSession, os.path.join(path, f"dt={dt}", f"execution_id={execution_id}"))
    (
        valid.withColumns({"dt": F.lit(dt), "execution_id": F.lit(execution_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt", "execution_id")
        .parquet(path)
    )


def dead_letter(rejected: DataFrame, path: str, execution_id: str) -> None:
    """Rejected rows with their reason as JSON lines, one folder per execution."""
    payload = [c for c in settings.TELEMETRY_FIELDS if c in rejected.columns]
    (
        rejected.select(
            *[c for c in ("event_id",) if c in rejected.columns],
            F.to_json(F.struct(*payload)).alias("record"),
            "rejection_reason",
            "corruption_type",
            F.lit(execution_id).alias("execution_id"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("execution_id")
        .json(path)
    )


def write_gold(stats: DataFrame, path: str) -> None:
    """Feature statistics as Parquet (also the feature store's input) and as JSON.

    They carry the time they were computed at, and the JSON is made from the written table, so they
    are worked out once.
    """
    table = os.path.join(path, "feature_statistics")
    stamped = stats if "computed_at" in stats.columns else stats.withColumn("computed_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(table)
    written = stats.sparkSession.read.schema(stamped.schema).parquet(table)
    written.write.mode("overwrite").json(os.path.join(path, "feature_statistics_json"))


def load(
    spark: SparkSession, path: str, fixture: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """A lake table, or a Parquet or CSV file in its place.

    A CSV file's columns get the types of ``schema``, by default those of the telemetry table; columns
    that neither names stay text.
    """
    source = fixture or path
    if source.endswith(".csv"):
        raw = spark.read.option("header", True).csv(source)
        types = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        known = {f.name: f.dataType for f in types} if types else {**_TELEMETRY_TYPES, "timestamp": "timestamp"}
        return raw.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in raw.columns])
    return spark.read.parquet(source)
