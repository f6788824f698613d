"""Threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.operators.ordered import carry_forward
from plantpulse.operators.validate import zero_filled
from plantpulse.schemas import Thresholds


def alert_id(event_id: Column, rule: Column) -> Column:
    return F.concat_ws(":", event_id, rule)


def _fire(events: DataFrame, temperature: Column, vibration: Column, created_at: Column) -> DataFrame:
    """One pass over the readings: both rules become array entries and only those that fire are kept."""
    hits = F.filter(
        F.array(
            F.struct(F.lit(S.ALERT_RULES[0]).alias("rule"), temperature.alias("threshold"), F.col("temperature_c").alias("observed")),
            F.struct(F.lit(S.ALERT_RULES[1]).alias("rule"), vibration.alias("threshold"), F.col("vibration_mm_s").alias("observed")),
        ),
        lambda hit: hit["observed"] >= hit["threshold"],
    )
    return events.select(
        "device_id", "event_id", "event_time", created_at.alias("created_at"), F.inline(hits)
    ).select(
        alert_id(F.col("event_id"), F.col("rule")).alias("alert_id"),
        "device_id",
        "event_id",
        "rule",
        "threshold",
        "observed",
        "event_time",
        "created_at",
    )


#: What of an alert an expected list fixes.
GOLDEN = ["alert_id", "device_id", "event_id", "rule", "threshold", "observed"]


def evaluate_alerts(events: DataFrame, thresholds: Thresholds = Thresholds(), created_at: Column | None = None) -> DataFrame:
    """At most one alert per reading and rule; a reading equal to the threshold fires (A1, A2)."""
    thresholds.check()
    when = F.col("received_at") if created_at is None else created_at
    return _fire(events, F.lit(thresholds.temperature_c), F.lit(thresholds.vibration_mm_s), when)


def evaluate_with_history(events: DataFrame, history: DataFrame, at: str = "processed_at") -> DataFrame:
    """Each reading meets the thresholds in force when it was processed (A3).

    `history` has (valid_from, temperature_c, vibration_mm_s), as many entries as there are; it is merged into the
    readings in time order. Readings from before the first entry raise nothing.
    """
    rows = events.select(F.struct("*").alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_side"))
    marks = history.select(
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
        F.col("valid_from").alias("_at"),
        F.lit(0).alias("_side"),
        F.struct("valid_from", F.col("temperature_c").alias("t_limit"), F.col("vibration_mm_s").alias("v_limit")).alias("_limits"),
    )
    both = rows.withColumn("_limits", F.lit(None).cast(marks.schema["_limits"].dataType)).unionByName(marks)
    merged = carry_forward(both, [], ["_at", "_side"], "_limits", "_now")
    dated = merged.where(F.col("_side") == 1).select("_row.*", "_now")
    return _fire(dated, F.col("_now.t_limit"), F.col("_now.v_limit"), F.col(at))


def alerts_for_new(outcomes: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Only rows that were stored now are evaluated, so a replay raises nothing (A4)."""
    return evaluate_alerts(outcomes.where(F.col("outcome") == "stored"), thresholds)


def merge_alerts(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """Alerts whose id is not stored yet, each id once (A5): the one that was made first, then by its values."""
    known = existing.select("alert_id").join(alerts.select("alert_id"), "alert_id", "left_semi")
    order = ["created_at", "event_time", "device_id", "event_id", "rule", "observed", "threshold"]
    first = alerts.groupBy("alert_id").agg(F.min_by(F.struct(*alerts.columns), F.struct(*[c for c in order if c in alerts.columns])).alias("_first"))
    return first.join(known, "alert_id", "left_anti").select("_first.*")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per rule, zero-filled."""
    return zero_filled(alerts.groupBy("rule").agg(F.count("*").alias("n")), "rule", S.ALERT_RULES)


def alert_counts_by_device(alerts: DataFrame) -> DataFrame:
    """Alerts per device and rule with the highest observed value."""
    return alerts.groupBy("device_id", "rule").agg(
        F.count("*").alias("n"), F.max("observed").alias("max_observed")
    )


def golden_alerts(fired: DataFrame, expected: DataFrame) -> DataFrame:
    """Alerts against an expected list, per rule (L16): how many there are on both sides, missing and unexpected.

    Alerts are the same when all of `GOLDEN` agree; repeated ones count as often as they occur. Rows of both sides are
    counted by their values, so no side is joined to the other.
    """
    sides = fired.select(*GOLDEN, F.lit(1).alias("_d")).unionByName(expected.select(*GOLDEN, F.lit(-1).alias("_d")))
    per = sides.groupBy(*GOLDEN).agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") == 1).alias("_f"), F.count_if(F.col("_d") == -1).alias("_e"))
    return per.groupBy("rule").agg(
        F.sum("_e").alias("expected"), F.sum("_f").alias("fired"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("_d"), F.lit(0))).alias("unexpected"),
    )
