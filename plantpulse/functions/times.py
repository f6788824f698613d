"""RFC 3339 texts and instants."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format: date, T, time, optional fraction, Z or a numeric offset.
RFC3339 = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def parse_rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text, else NULL. The gate is needed because a cast also accepts bare dates."""
    return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))


def in_supported_years(t: Column) -> Column:
    return F.year(t).between(1970, 9999)


def format_ms(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_nano(t: Column) -> Column:
    """Microseconds with the trailing zeros of the fraction removed."""
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def micros(t: Column) -> Column:
    return F.unix_micros(t)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def parse_rfc3339_text(text: str) -> datetime:
    """Driver-side form for query arguments; precision below a microsecond is cut."""
    match = re.fullmatch(
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})", text or ""
    )
    if not match:
        raise ValueError("not an RFC 3339 timestamp")
    base = datetime.strptime(match[1], "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
    base += timedelta(microseconds=int((match[2] or "0")[:6].ljust(6, "0")))
    if match[3] != "Z":
        sign = 1 if match[3][0] == "+" else -1
        base -= sign * timedelta(hours=int(match[3][1:3]), minutes=int(match[3][4:6]))
    return base


def instant(value: "datetime | str") -> Column:
    """Literal instant, independent of the zone of the driver process."""
    if isinstance(value, str):
        value = parse_rfc3339_text(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    us = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return F.timestamp_micros(F.lit(us).cast("bigint"))
