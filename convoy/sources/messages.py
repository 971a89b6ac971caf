"""Message sources and payload decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy import settings
from convoy.functions.coerce import computed_once

# Fields are read as text first, so that a wrong type is a rule violation and not a lost row.
_CORRUPT = "_corrupt"
RAW_FIELDS = T.StructType([T.StructField(f, T.StringType()) for f in settings.TELEMETRY_FIELDS])


def file_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Text files as a stream of messages, one per line, from the earliest file on."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int) -> DataFrame:
    """A Kafka topic as a stream of messages, from the earliest offsets on.

    Needs Spark's Kafka connector on the class path.
    """
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def decode(messages: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse payloads; ``codec`` is json, or raw for anything that is not a JSON object."""
    # One parse: what is not a JSON object ends up whole in the column for corrupt records.
    schema = T.StructType([*RAW_FIELDS.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    text = F.col(value)
    parsed = messages.select(
        *(keep or []), text.alias("raw_value"), F.from_json(text, schema, options).alias("_m")
    )
    good = F.coalesce(F.col(f"_m.{_CORRUPT}").isNull() & F.ltrim("raw_value").startswith("{"), F.lit(False))
    fields = [F.when(good, F.col(f"_m.{f}")).alias(f) for f in RAW_FIELDS.names]
    codec = F.when(good, "json").otherwise("raw").alias("codec")
    return computed_once(parsed.select(*(keep or []), codec, "raw_value", *fields), keep)
