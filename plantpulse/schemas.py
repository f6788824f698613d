"""Schemas and the closed value sets shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("vibration_mm_s", T.DoubleType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("idx", T.IntegerType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("observed", T.DoubleType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# A rejection names the record by position and never carries its payload.
REJECTION_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_no", T.IntegerType()),
        T.StructField("attempt_no", T.IntegerType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("n_records", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("is_ack", T.BooleanType()),
        T.StructField("ack_accepted", T.IntegerType()),
        T.StructField("ack_rejected", T.IntegerType()),
        T.StructField("ack_rejection_counts", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("will_retry", T.BooleanType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("external", T.BooleanType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("elapsed_s", T.DoubleType()),
        T.StructField("planned", T.IntegerType()),
        T.StructField("batches", T.IntegerType()),
        T.StructField("config", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------
# Fixed values of the data contract (names, order, texts and bounds as published).
# ---------------------------------------------------------------------------
SCHEMA_VERSION = 1

SCHEMA_FIELDS = [
    "schema_version",
    "event_id",
    "device_id",
    "event_time",
    "sequence",
    "temperature_c",
    "vibration_mm_s",
    "site_id",
]

REQUIRED_IMPORT_FIELDS = ["event_time", "device_id", "temperature_c", "vibration_mm_s"]

COLUMN_ALIASES = {
    "event_time": [
        "timestamp", "time", "ts", "datetime", "date_time", "event_timestamp", "time_utc", "measured_at",
    ],
    "device_id": [
        "device", "device_name", "machine", "machine_id", "sensor", "sensor_id", "asset", "asset_id",
    ],
    "temperature_c": ["temperature", "temp", "temp_c", "temperature_celsius", "temperature_degc"],
    "vibration_mm_s": ["vibration", "vib", "vibration_mms", "vibration_mm_per_s", "vibration_rms"],
    "event_id": ["id", "eventid", "reading_id", "message_id"],
    "sequence": ["seq", "sequence_number", "counter"],
    "site_id": ["site", "plant", "plant_id", "facility"],
    "schema_version": ["version"],
}

REASONS = [
    "malformed_json",
    "unknown_field",
    "unsupported_schema_version",
    "missing_field",
    "invalid_event_id",
    "invalid_device_id",
    "invalid_site_id",
    "invalid_timestamp",
    "time_in_future",
    "invalid_sequence",
    "out_of_range",
    "duplicate_in_batch",
]

REASON_LABELS = {
    "malformed_json": "value of the wrong type or unreadable",
    "unknown_field": "unknown field",
    "unsupported_schema_version": "unsupported schema version",
    "missing_field": "missing value",
    "invalid_event_id": "invalid event id",
    "invalid_device_id": "invalid device id",
    "invalid_site_id": "invalid site id",
    "invalid_timestamp": "invalid time",
    "time_in_future": "time in the future",
    "invalid_sequence": "invalid sequence number",
    "out_of_range": "value out of range",
    "duplicate_in_batch": "repeated within one batch",
}

ID_RULE = "[A-Za-z0-9][A-Za-z0-9._:-]{0,63}"

DETAIL_SHAPE = "record is not a valid JSON object of the expected shape"
DETAIL_UNKNOWN = "record contains a field that is not part of schema v1"
DETAIL_TIME_FORMAT = "event_time must be an RFC 3339 timestamp"
DETAIL_TIME_YEAR = "event_time year out of supported range"
DETAIL_TIME_FUTURE = "event_time is further in the future than the allowed clock skew"
DETAIL_SEQUENCE = "sequence must be >= 0"
DETAIL_REPEATED_ID = "event_id already appears earlier in this batch"
DETAIL_REPEATED_SEQUENCE = "device_id and sequence already appear earlier in this batch"

ENVELOPE_DETAILS = {
    "invalid_json": 'body must be a JSON object like {"events":[...]}',
    "trailing_data": "unexpected data after the JSON object",
    "empty_batch": "events must contain at least one record",
    "batch_too_large": "too many events in one request",
    "payload_too_large": "request body exceeds the configured limit",
}

ALERT_RULES = ["temperature_high", "vibration_high"]

INGEST_OUTCOMES = ["accepted", "rejected_invalid", "rejected_overload", "rejected_shutdown"]
PROCESSED_OUTCOMES = ["stored", "duplicate", "failed"]
FAILURE_STAGES = ["persist", "alert_persist", "shutdown_drop"]

LATENCY_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
LAG_BOUNDS = [0.01, 0.1, 0.5, 1.0, 5.0, 30.0, 60.0, 300.0, 3600.0, 86400.0, 31536000.0]

MALFORMED_KINDS = [
    "missing_field",
    "wrong_type",
    "out_of_range",
    "bad_timestamp",
    "bad_schema_version",
    "bad_id",
]

EVENT_EXPORT_COLUMNS = [
    "event_id", "device_id", "site_id", "event_time", "received_at", "sequence", "temperature_c", "vibration_mm_s",
]
ALERT_EXPORT_COLUMNS = [
    "alert_id", "device_id", "event_id", "rule", "threshold", "observed", "event_time", "created_at",
]

SCRAPE_COLUMNS = [
    "queue_depth", "accepted", "rejected_invalid", "rejected_overload", "stored", "duplicate", "failed",
]

MAX_BATCH_EVENTS = 500
MAX_BODY_BYTES = 1 << 20
MAX_REPORTED_REJECTIONS = 50
MAX_REJECTION_EXAMPLES = 3
MAX_REPORT_DEVICES = 20
MIN_INTERVALS_FOR_GAP = 5
GAP_FACTOR = 3
STUCK_RUN_LENGTH = 10
TREND_POINTS = 60
MAX_FEED_ALERTS = 100
MAX_RUN_HISTORY = 30
MAX_REPORT_SECONDS = 120
EXPORT_PAGE_ROWS = 1000
QUERY_DEFAULT_LIMIT = 100
QUERY_MAX_LIMIT = 1000
QUERY_MAX_RANGE_S = 24 * 3600
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Plausibility bounds used by validation; the defaults are the published ones."""

    temp_min_c: float = -50.0
    temp_max_c: float = 250.0
    vib_max_mm_s: float = 100.0
    max_future_skew_s: int = 300


@dataclass(frozen=True)
class Thresholds:
    """Inclusive alert thresholds."""

    temperature_c: float = 85.0
    vibration_mm_s: float = 7.1

    def check(self, limits: Limits = Limits(), positive: bool = False) -> "Thresholds":
        """Refuse thresholds no valid reading could ever reach."""
        if not limits.temp_min_c <= self.temperature_c <= limits.temp_max_c:
            raise ValueError("the temperature threshold must lie within the temperature bounds")
        if not 0 <= self.vibration_mm_s <= limits.vib_max_mm_s:
            raise ValueError("the vibration threshold must lie within the vibration bounds")
        if positive and (self.temperature_c <= 0 or self.vibration_mm_s <= 0):
            raise ValueError("thresholds must be greater than zero")
        return self
