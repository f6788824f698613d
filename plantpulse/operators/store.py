"""Query surface and storage aggregates over stored events and alerts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.cursors import cursor_token, decode_cursor
from plantpulse.functions.times import instant, parse_rfc3339_text
from plantpulse.operators.ordered import InOrder
from plantpulse.schemas import Thresholds


IDS = {"events": "event_id", "alerts": "alert_id"}
PARTITION = "event_date"


@dataclass(frozen=True)
class Query:
    """Half-open time range, optional device, page size and position (checked by `make_query`)."""

    start: datetime
    end: datetime
    device_id: str | None = None
    limit: int = S.QUERY_DEFAULT_LIMIT
    after: tuple[datetime, str] | None = None


def make_query(
    start: str | None = None,
    end: str | None = None,
    device_id: str | None = None,
    limit: "int | str | None" = None,
    cursor: str | None = None,
    browse: bool = False,
    now: datetime | None = None,
) -> Query:
    """Check the arguments (Q5). `browse` lifts the range cap and defaults to everything up to a year ahead."""
    if device_id and not re.fullmatch(S.ID_RULE, device_id):
        raise ValueError("device_id is not a valid identifier")

    def time(text: str | None, name: str, default: datetime | None) -> datetime:
        if not text:
            if default is None:
                raise ValueError(f"{name} is required (RFC 3339 timestamp)")
            return default
        try:
            return parse_rfc3339_text(text)
        except ValueError:
            raise ValueError(f"{name} must be an RFC 3339 timestamp") from None

    now = now or datetime.now(timezone.utc)
    begin = time(start, "from", datetime(1970, 1, 1, tzinfo=timezone.utc) if browse else None)
    stop = time(end, "to", now + timedelta(days=366) if browse else None)
    if begin >= stop:
        raise ValueError("from must be before to")
    if not browse and (stop - begin).total_seconds() > S.QUERY_MAX_RANGE_S:
        raise ValueError("time range exceeds the maximum of 24h0m0s")
    size = S.QUERY_DEFAULT_LIMIT
    if limit not in (None, ""):
        if not re.fullmatch(r"[+-]?\d+", str(limit)) or not 1 <= int(limit) <= S.QUERY_MAX_LIMIT:
            raise ValueError(f"limit must be an integer between 1 and {S.QUERY_MAX_LIMIT}")
        size = int(limit)
    return Query(begin, stop, device_id or None, size, decode_cursor(cursor) if cursor else None)


def selected(df: DataFrame, q: Query) -> DataFrame:
    """Rows of the range and device. A stored table is also pruned to the dates of the range."""
    t = F.col("event_time")
    out = df.where((t >= instant(q.start)) & (t < instant(q.end)))
    if PARTITION in df.columns:
        out = out.where(F.col(PARTITION).between(F.lit(q.start.date()), F.lit(q.end.date())))
    if q.device_id:
        out = out.where(F.col("device_id") == q.device_id)
    return out


def after(df: DataFrame, position: tuple[datetime, str], id_col: str) -> DataFrame:
    """Rows behind a keyset position (Q3). The plain lower bound on time is redundant but reaches the file scan."""
    t, here = F.col("event_time"), instant(position[0])
    return df.where((t >= here) & ((t > here) | ((t == here) & (F.col(id_col) > position[1]))))


def page(df: DataFrame, q: Query, kind: str = "events") -> DataFrame:
    """One page in (event_time, id) order (Q1, Q2). One row more is read to know whether `next_cursor` is due.

    Sort and limit become one top-n per task followed by a merge.
    """
    row_id = IDS[kind]
    rows = selected(df, q)
    if q.after:
        rows = after(rows, q.after, row_id)
    top = rows.orderBy("event_time", row_id).limit(q.limit + 1)
    place = Window.orderBy("event_time", row_id)  # over at most limit + 1 rows
    numbered = top.withColumn("_n", F.row_number().over(place)).withColumn("_all", F.count("*").over(Window.partitionBy()))
    token = F.when((F.col("_n") == q.limit) & (F.col("_all") > q.limit), cursor_token(F.col("event_time"), F.col(row_id)))
    return numbered.where(F.col("_n") <= q.limit).withColumn("next_cursor", token).drop("_n", "_all")


def pages(df: DataFrame, q: Query, kind: str = "events") -> DataFrame:
    """Every row of the query with its page number (Q6), as a walk over all pages would return them."""
    rank = InOrder(selected(df, q), [], ["event_time", IDS[kind]]).rank("_n")
    return rank.withColumn("page", F.floor((F.col("_n") - 1) / q.limit).cast("bigint")).drop("_n")


def newest_alerts(alerts: DataFrame, n: int = S.MAX_FEED_ALERTS) -> DataFrame:
    """Alert feed, newest first (Q7)."""
    return alerts.orderBy(F.col("created_at").desc(), F.col("alert_id").desc()).limit(n)


def run_history(runs: DataFrame, n: int = S.MAX_RUN_HISTORY) -> DataFrame:
    """Newest runs first (Q8)."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION, F.to_date("event_time"))


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append events or alerts, one folder per event date."""
    with_date(df).write.mode(mode).partitionBy(PARTITION).parquet(path)


def storage_stats(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Exact counts, devices and time span (G1)."""
    per_device = events.groupBy("device_id").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    totals = per_device.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count("device_id").alias("devices"),
        F.min("first").alias("first_event"),
        F.max("last").alias("last_event"),
    )
    return totals.withColumn("alerts", alerts.agg(F.count("*")).scalar())


def device_counts(events: DataFrame) -> DataFrame:
    """Rows per device, by name."""
    return events.groupBy("device_id").agg(F.count("*").alias("events")).orderBy("device_id")


def latest_per_device(events: DataFrame, arrival: list[str], columns: list[str] | None = None) -> DataFrame:
    """Last arrived reading of each device (G3); one row per task and device is shuffled."""
    kept = columns or [c for c in events.columns if c != "device_id"]
    newest = events.groupBy("device_id").agg(F.max_by(F.struct(*kept), F.struct(*arrival)).alias("_m"))
    return newest.select("device_id", "_m.*").orderBy("device_id")


def recent_trend(
    events: DataFrame, arrival: list[str], thresholds: Thresholds = Thresholds(), n: int = S.TREND_POINTS
) -> DataFrame:
    """Last `n` values per device in arrival order with range and hits.

    Spark limits the ranking per task before the shuffle, so a busy device sends at most `n` rows from each.
    """
    newest = Window.partitionBy("device_id").orderBy(*[F.col(c).desc() for c in arrival])
    kept = (
        events.select("device_id", *arrival, "temperature_c", "vibration_mm_s")
        .withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= n)
        .groupBy("device_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("o"), "temperature_c", "vibration_mm_s"))).alias("p"))
    )

    def series(name: str, value: str, threshold: float) -> list[Column]:
        values = F.transform("p", lambda x: x[value])
        return [
            values.alias(f"{name}_values"),
            F.least(F.array_min(values), F.lit(threshold)).alias(f"{name}_low"),
            F.greatest(F.array_max(values), F.lit(threshold)).alias(f"{name}_high"),
            F.size(F.filter(values, lambda v: v >= threshold)).alias(f"{name}_hits"),
        ]

    return kept.select(
        "device_id",
        F.size("p").alias("points"),
        *series("temperature", "temperature_c", thresholds.temperature_c),
        *series("vibration", "vibration_mm_s", thresholds.vibration_mm_s),
    )


def highlight_alerts(latest: DataFrame, alerts: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Rules that fired for the shown reading, and those its values reach now."""
    shown = alerts.join(latest.select("event_id"), "event_id", "left_semi")
    fired = shown.groupBy("event_id").agg(F.array_sort(F.collect_set("rule")).alias("fired"))
    joined = latest.join(fired, "event_id", "left")
    over = F.array_compact(
        F.array(
            F.when(F.col("temperature_c") >= thresholds.temperature_c, F.lit(S.ALERT_RULES[0])),
            F.when(F.col("vibration_mm_s") >= thresholds.vibration_mm_s, F.lit(S.ALERT_RULES[1])),
        )
    )
    none = F.array().cast("array<string>")
    return joined.withColumn("fired", F.coalesce("fired", none)).withColumn(
        "marked", F.array_sort(F.array_union("fired", over))
    )


def clear_data(spark: SparkSession, events_path: str, alerts_path: str, confirm: str) -> DataFrame:
    """Empty both tables and say how much was deleted (G6). Alerts go first, as they refer to events."""
    if confirm != "DELETE":
        raise ValueError('pass confirm="DELETE" to delete all events and alerts')
    deleted = {}
    for name, path in (("alerts", alerts_path), ("events", events_path)):
        old = spark.read.parquet(path)
        deleted[name] = old.count()
        # Only the schema is read from the table, so overwriting its path is safe.
        spark.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)
    return spark.range(1).select(
        F.lit(deleted["events"]).alias("deleted_events"), F.lit(deleted["alerts"]).alias("deleted_alerts")
    )


def state_as_of(messages: DataFrame, at: int) -> dict[str, DataFrame]:
    """Live view rebuilt from messages (`offset`, `type`, event fields, `rule`) up to an offset."""
    seen = messages.where(F.col("offset") <= at)
    events, alerts = seen.where(F.col("type") == "event"), seen.where(F.col("type") == "alert")
    fired = alerts.groupBy("event_id").agg(F.array_sort(F.collect_set("rule")).alias("fired"))
    latest = latest_per_device(events, ["offset"], ["event_id", "event_time", "temperature_c", "vibration_mm_s"])
    return {
        "counts": seen.agg(
            F.count_if(F.col("type") == "event").alias("events"), F.count_if(F.col("type") == "alert").alias("alerts")
        ),
        "devices": latest.join(fired, "event_id", "left"),
        "alerts": alerts.orderBy(F.col("offset").desc()).limit(S.MAX_FEED_ALERTS),
    }


def states_as_of(messages: DataFrame, times: list[int]) -> DataFrame:
    """Per asked offset and device: readings so far and the latest one (G7 for many offsets at once).

    Each message counts once, for the first asked offset that includes it; the later offsets are filled from those
    small per-device rows, not from the messages.
    """
    asked = F.array(*[F.lit(t).cast("bigint") for t in sorted(set(times))])
    first = F.get(F.filter(asked, lambda t: t >= F.col("offset")), F.lit(0))
    part = (
        messages.where(F.col("type") == "event")
        .withColumn("asked", first)
        .where(F.col("asked").isNotNull())
        .groupBy("device_id", "asked")
        .agg(F.count("*").alias("n"), F.max_by("event_id", "offset").alias("event_id"))
    )
    grid = part.select("device_id").distinct().select("device_id", F.explode(asked).alias("asked"))
    so_far = Window.partitionBy("device_id").orderBy("asked")
    return (
        grid.join(part, ["device_id", "asked"], "left")
        .select(
            "asked",
            "device_id",
            F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("events"),
            F.last("event_id", ignorenulls=True).over(so_far).alias("event_id"),
        )
        .where(F.col("events") > 0)
    )
