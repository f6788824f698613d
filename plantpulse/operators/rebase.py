"""Moving old recordings to the present."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.times import format_ms, instant, parse_rfc3339


def _shifted(df: DataFrame, anchor_us: Column, now: datetime) -> DataFrame:
    t = parse_rfc3339(F.col("event_time"))
    offset = F.unix_micros(instant(now)) - anchor_us
    moved = format_ms(F.timestamp_micros(F.unix_micros(t) + offset))
    return df.withColumn("event_time", F.coalesce(moved, F.col("event_time")))


def rebase_latest(df: DataFrame, now: datetime) -> DataFrame:
    """Shift every readable time by one offset so that the latest becomes `now`; the rest stays as it is."""
    latest = df.agg(F.max(F.unix_micros(parse_rfc3339(F.col("event_time"))))).scalar()
    return _shifted(df, latest, now)


def rebase_first(df: DataFrame, now: datetime, row: str = "row_no") -> DataFrame:
    """Shift by one offset so that the first record in file order becomes `now`."""
    first = df.agg(F.min_by(F.unix_micros(parse_rfc3339(F.col("event_time"))), row)).scalar()
    return _shifted(df, first, now)
