"""Live messages (P9): what a monitor needs of a stored reading or an alert, as one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.times import format_nano

FRAME_FIELDS = {
    "event": ["event_id", "device_id", "event_time", "temperature_c", "vibration_mm_s"],
    "alert": ["alert_id", "device_id", "event_id", "rule", "threshold", "observed", "event_time"],
}


def frame_payload(df: DataFrame, kind: str) -> DataFrame:
    value: dict[str, Column] = {c: F.col(c) for c in FRAME_FIELDS[kind]}
    value["event_time"] = format_nano(F.col("event_time"))
    data = F.struct(*[c.alias(n) for n, c in value.items()])
    text = F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data")))
    return df.select(F.lit(kind).alias("type"), "device_id", text.alias("payload"))


def live_frames(stored: DataFrame, alerts: DataFrame, device_id: str | None = None) -> DataFrame:
    """Messages of newly stored readings and their alerts, optionally of one device (T5)."""
    both = frame_payload(stored, "event").unionByName(frame_payload(alerts, "alert"))
    return both.where(F.col("device_id") == device_id) if device_id else both
