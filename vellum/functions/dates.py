"""Timestamp text. Stored times are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPLAY = "yyyy-MM-dd HH:mm:ss"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def local_text(ts: Column, zone: str, pattern: str = DISPLAY) -> Column:
    """UTC time as shown in a zone; null becomes empty."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), pattern), F.lit(""))


def list_text(ts: Column, now: Column, zone: str = "Asia/Shanghai") -> Column:
    """As lists show it; a missing time shows the given present."""
    return local_text(F.coalesce(ts, now), zone, "yyyy/MM/dd HH:mm:ss")


def parsed_utc(text: Column) -> Column:
    """ISO text to UTC time; text without an offset counts as UTC, any offset is honoured."""
    zoned = F.regexp_like(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$"))
    full = F.when(zoned, text).otherwise(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(full).cast("timestamp_ntz"))


def last_touched(updated: Column, created: Column) -> Column:
    return F.coalesce(updated, created)
