"""Column expressions that turn dirty wire values into typed ones, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy import settings

# Decimal, exponent, inf and nan forms, with padding; no underscores and no type suffixes.
_NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"

# Date alone, or date and time to the minute, second or fraction, with an optional zone.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
# White space in the Unicode sense.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def computed_once(df: DataFrame, plain: list[str] | None = None) -> DataFrame:
    """Keep the optimizer from copying the frame's column expressions into later filters.

    A filter on a derived column is normally pushed below it as a copy of its expression, so
    a parsed payload would be parsed again for every rule that reads a field of it. Columns
    named in ``plain`` stay outside, so that filters on them still reach the scan.
    """
    plain = plain or []
    derived = [c for c in df.columns if c not in plain]
    return df.select(*plain, F.inline(F.array(F.struct(*derived))))


def number(text: Column) -> Column:
    """Text to double; null when it is not a number."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def numeric_field(df: DataFrame, name: str) -> Column:
    """The field as double, whether the frame holds it as text or as a number."""
    kind = df.schema[name].dataType
    return number(F.col(name)) if isinstance(kind, T.StringType) else F.col(name).cast("double")


def iso_instant(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; text without a zone is taken as UTC."""
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def any_instant(text: Column) -> Column:
    """ISO text, epoch seconds or epoch milliseconds (above 1e12) to a UTC instant."""
    epoch = number(text)
    seconds = F.when(epoch > F.lit(1e12), epoch / F.lit(1000.0)).otherwise(epoch)
    micros = F.round(seconds * F.lit(1e6)).try_cast("long")
    return F.coalesce(
        F.when(epoch.isNotNull() & ~F.isnan(epoch), F.timestamp_micros(micros)),
        iso_instant(strip(text)),
    )


def iso_text(instant: Column) -> Column:
    """Instant to ISO-8601 text with microseconds and a UTC offset."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def given_text(field: str) -> str:
    """The column that keeps a coerced field's original text."""
    return f"{field}_text"


def record_key(df: DataFrame) -> Column:
    """What names a record and orders it among others of the same instant.

    The event id where there is one, else the place in the source, else a hash of the payload or of
    the contract's fields.
    """
    if "event_id" in df.columns:
        return F.col("event_id")
    if {"partition", "offset"} <= set(df.columns):
        return F.format_string("%010d-%020d", F.col("partition").cast("long"), F.col("offset").cast("long"))
    if "raw_value" in df.columns:
        return F.md5(F.col("raw_value").cast("binary"))
    fields = [F.col(c) for c in settings.TELEMETRY_FIELDS if c in df.columns]
    return F.md5(F.to_json(F.struct(*fields)).cast("binary"))


def quoted(value: Column) -> Column:
    """The value as it is shown inside a violation message."""
    return F.coalesce(F.concat(F.lit("'"), value.cast("string"), F.lit("'")), F.lit("None"))


def _alias(text: Column, names: tuple[str, ...], prefix: str) -> Column:
    upper = F.upper(text)
    full = F.when(upper.isin(*names), upper).when(
        F.concat(F.lit(prefix), upper).isin(*names), F.concat(F.lit(prefix), upper)
    )
    return F.coalesce(full, F.lit(prefix + "UNSPECIFIED"))


def sensor_status(text: Column) -> Column:
    """Short or full status name in any case to the contract's symbol."""
    return _alias(text, settings.SENSOR_STATUSES, "SENSOR_STATUS_")


def device_type(text: Column) -> Column:
    return _alias(text, settings.DEVICE_TYPES, "DEVICE_TYPE_")


def incident_severity(text: Column) -> Column:
    """Short severity (critical, warning, info) in any case to the contract's symbol."""
    name = F.concat(F.lit("INCIDENT_SEVERITY_"), F.upper(text))
    return F.when(name.isin(*settings.INCIDENT_SEVERITIES), name).otherwise(
        "INCIDENT_SEVERITY_UNSPECIFIED"
    )


def incident_status(text: Column) -> Column:
    name = F.concat(F.lit("INCIDENT_STATUS_"), F.upper(text))
    return F.when(name.isin(*settings.INCIDENT_STATUSES), name).otherwise(
        "INCIDENT_STATUS_UNSPECIFIED"
    )


def vehicle_mention(text: Column) -> Column:
    """First vehicle id mentioned in free text, padded to four digits; null if none."""
    digits = F.regexp_extract(text, r"(?i)vh-?\s*0*(\d{1,8})", 1)
    plain = F.nullif(digits, F.lit("")).cast("long").cast("string")
    wide = F.greatest(F.length(plain), F.lit(4))
    return F.concat(F.lit("VH-"), F.lpad(plain, wide, F.lit("0")))
