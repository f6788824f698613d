"""Fault injection on tables of records (I1-I6), to test what reads them.

Each row draws its own numbers from a hash of (seed, row number, purpose): the plan does not depend on how the rows
are partitioned, and the rate of one fault does not move another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.times import format_ms, parse_rfc3339
from plantpulse.operators.ordered import InOrder


@dataclass(frozen=True)
class FaultRates:
    seed: int = 0
    malformed: float = 0.0
    late: float = 0.0
    duplicate: float = 0.0
    late_seconds: float = 120.0

    def check(self) -> "FaultRates":
        for name in ("malformed", "late", "duplicate"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"the {name} rate must be within [0, 1]")
        if self.late_seconds < 0:
            raise ValueError("late_seconds must not be negative")
        return self


def uniform(seed: int, row: Column, purpose: str) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row, F.lit(purpose)), 11) / F.lit(float(1 << 53))


def plan_faults(records: DataFrame, rates: FaultRates, row: str = "row_no") -> DataFrame:
    """The records as they will be sent: (row_no, copy_no, kind, malformed_kind, t_rel, body).

    `records` holds the schema fields with the time as text. A malformed record gets no other fault; a duplicate
    follows its original and equals it; `t_rel` is the time since the first record before any fault.
    """
    rates.check()
    r = F.col(row)
    draw = lambda purpose: uniform(rates.seed, r, purpose)
    bad, late, twice = draw("malformed") < rates.malformed, draw("late") < rates.late, draw("duplicate") < rates.duplicate
    which = F.floor(draw("kind") * len(S.MALFORMED_KINDS)).cast("int")
    kinds = F.array(*[F.lit(k) for k in S.MALFORMED_KINDS])
    t = parse_rfc3339(F.col("event_time"))
    first = records.agg(F.min_by(F.unix_micros(t), r)).scalar()
    moved = format_ms(F.timestamp_micros(F.unix_micros(t) - int(rates.late_seconds * 1_000_000)))
    planned = records.select(
        r.alias("row_no"),
        *S.SCHEMA_FIELDS,
        F.when(bad, F.get(kinds, which)).alias("malformed_kind"),
        (~bad & late).alias("_late"),
        (~bad & twice).alias("_twice"),
        F.coalesce((F.unix_micros(t) - first) / 1e6, F.lit(0.0)).alias("t_rel"),
    ).withColumn("event_time", F.when(F.col("_late") & t.isNotNull(), moved).otherwise(F.col("event_time")))
    is_kind = lambda k: F.col("malformed_kind").eqNullSafe(k)
    fields = {
        "schema_version": F.when(is_kind("bad_schema_version"), 99).otherwise(F.col("schema_version")),
        "event_id": F.when(is_kind("bad_id"), "bad id!").otherwise(F.col("event_id")),
        "device_id": F.col("device_id"),
        "event_time": F.when(is_kind("bad_timestamp"), "not-a-timestamp").otherwise(F.col("event_time")),
        "sequence": F.col("sequence"),
        "temperature_c": F.when(is_kind("out_of_range"), 9999.0).when(~is_kind("missing_field"), F.col("temperature_c")),
        "vibration_mm_s": F.col("vibration_mm_s"),
        "site_id": F.col("site_id"),
    }
    as_json = lambda f: F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))
    body = F.when(is_kind("wrong_type"), as_json({**fields, "temperature_c": F.lit("hot")})).otherwise(as_json(fields))
    kind = F.when(F.col("malformed_kind").isNotNull(), "malformed").when(F.col("_late"), "late").otherwise("ok")
    copies = F.sequence(F.lit(0), F.col("_twice").cast("int"))
    return planned.select("row_no", "malformed_kind", "t_rel", kind.alias("_kind"), body.alias("body"), F.explode(copies).alias("copy_no")).select(
        "row_no",
        "copy_no",
        F.when(F.col("copy_no") == 1, "duplicate").otherwise(F.col("_kind")).alias("kind"),
        "malformed_kind",
        "t_rel",
        "body",
    )


def fault_counts(plan: DataFrame) -> DataFrame:
    """Injected faults by kind, malformed ones also by what was done (I4)."""
    return plan.where(F.col("kind") != "ok").groupBy("kind", "malformed_kind").agg(F.count("*").alias("n"))


def expected_outcome(plan: DataFrame, batch_size: int, temperature: float, vibration: float, pieces: int | None = None) -> dict[str, DataFrame]:
    """What an ideal receiver ends up with (L15): stored ids, in-batch repeats and alert ids.

    Built from the plan alone, not from the operators it is compared with: the first well-formed version of each id
    is kept, and a repeat inside one request is refused.
    """
    sent = InOrder(plan, [], ["row_no", "copy_no"], pieces).rank("_n").withColumn(
        "batch_no", F.floor((F.col("_n") - 1) / batch_size)
    )
    good = sent.where(F.col("kind") != "malformed")
    value = lambda name, kind: F.get_json_object("body", f"$.{name}").cast(kind)
    versions = good.select(
        "_n", "batch_no", value("event_id", "string").alias("event_id"), value("temperature_c", "double").alias("temperature_c"),
        value("vibration_mm_s", "double").alias("vibration_mm_s"),
    )
    stored = versions.groupBy("event_id").agg(
        F.min_by(F.struct("temperature_c", "vibration_mm_s"), "_n").alias("m")
    ).select("event_id", "m.*")
    repeats = versions.groupBy("batch_no", "event_id").agg((F.count("*") - 1).alias("n")).agg(F.sum("n").alias("repeats"))
    hits = F.array_compact(
        F.array(
            F.when(F.col("temperature_c") >= temperature, F.concat("event_id", F.lit(":temperature_high"))),
            F.when(F.col("vibration_mm_s") >= vibration, F.concat("event_id", F.lit(":vibration_high"))),
        )
    )
    return {
        "sent": sent,
        "stored": stored.select("event_id"),
        "repeats": repeats,
        "alerts": stored.select(F.explode(hits).alias("alert_id")),
    }


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with how often: empty when both hold the same rows."""
    cols = expected.columns
    return (
        expected.exceptAll(actual.select(*cols)).withColumn("side", F.lit("missing"))
        .unionByName(actual.select(*cols).exceptAll(expected).withColumn("side", F.lit("unexpected")))
        .groupBy(*cols, "side")
        .agg(F.count("*").alias("n"))
    )
