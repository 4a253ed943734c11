"""Durations and timestamps."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of a unit.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def parse_duration(text: str) -> int:
    """Milliseconds of a duration such as 30s; ValueError if it isn't one."""
    m = re.fullmatch(r"([0-9]+)(ms|s|m|h|d)", text)
    if not m:
        raise ValueError(f"Invalid time window format: {text}")
    return int(m[1]) * UNITS[m[2]]


def parse_duration_col(text: Column) -> Column:
    """Milliseconds of a duration column, null where it isn't one."""
    unit = F.regexp_extract(text, "^[0-9]+(ms|s|m|h|d)$", 1)
    factor = F.lit(None).cast("long")
    for k, v in UNITS.items():
        factor = F.when(unit == k, F.lit(v).cast("long")).otherwise(factor)
    return F.regexp_extract(text, "^([0-9]+)", 1).try_cast("long") * factor


def format_duration(ms: int) -> str:
    for limit, size, unit in ((1_000, 1, "ms"), (60_000, 1_000, "s"), (3_600_000, 60_000, "m")):
        if ms < limit:
            return f"{ms // size}{unit}"
    return f"{ms // 3_600_000}h"


def format_duration_col(ms: Column) -> Column:
    part = lambda size, unit: F.concat(F.floor(ms / size).cast("long").cast("string"), F.lit(unit))
    return F.when(ms < 1_000, part(1, "ms")).when(ms < 60_000, part(1_000, "s")).when(ms < 3_600_000, part(60_000, "m")).otherwise(part(3_600_000, "h"))


def millis(timestamp: Column) -> Column:
    """Whole milliseconds since 1970 of an ISO 8601 text (UTC where it names no zone) or a timestamp; null if unreadable."""
    return F.expr("NULL").cast("long") if timestamp is None else F.floor(F.unix_micros(F.try_to_timestamp(timestamp.cast("string"))) / 1000).cast("long")


def millis_of_timestamp(ts: Column) -> Column:
    """Whole milliseconds of a timestamp column, rounded down; those without a zone are UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def is_valid_timestamp(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text).isNotNull(), F.lit(False))


def iso_text(ms: int) -> str:
    """What iso() gives for one number."""
    at = datetime.datetime.fromtimestamp(ms // 1000, datetime.UTC)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{ms % 1000:03d}Z"


def iso(ms: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ of milliseconds; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_of_nanos(ns: Column) -> Column:
    return iso(F.floor(ns.cast("decimal(38,0)") / 1_000_000).cast("long"))
