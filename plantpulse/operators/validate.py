"""Record validation (V1-V14): one reason per rejected record, decided by the first failing rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.numbers import is_finite
from plantpulse.functions.text import is_identifier
from plantpulse.functions.times import in_supported_years, parse_rfc3339
from plantpulse.schemas import Limits
from plantpulse.session import once

STRING_FIELDS = ["device_id", "event_id", "event_time", "site_id"]
INTEGER_FIELDS = ["schema_version", "sequence"]
NUMBER_FIELDS = ["temperature_c", "vibration_mm_s"]

VARIANT_TYPES = {
    **{f: "STRING|VOID" for f in STRING_FIELDS},
    **{f: "BIGINT|VOID" for f in INTEGER_FIELDS},
    **{f: r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|VOID" for f in NUMBER_FIELDS},
}

# A variant prints its fields sorted by name, so one pattern recognises every well-typed record.
WELL_SHAPED = (
    r"\A(VOID|OBJECT<"
    + "".join(rf"({name}: ({VARIANT_TYPES[name]})(, |(?=>)))?" for name in sorted(VARIANT_TYPES))
    + r">)\z"
)

CHECKED_COLUMNS = [*S.SCHEMA_FIELDS, "reason", "detail"]


def _field(name: str, sql_type: str) -> Column:
    return F.try_variant_get(F.col("_v"), f"$.{name}", sql_type)


def _first_offender() -> Column:
    """First key, in document order, that is unknown or holds a value of the wrong type."""

    def mistyped(name: str) -> Column:
        wrong = ~F.schema_of_variant(_field(name, "variant")).rlike(rf"\A({VARIANT_TYPES[name]})\z")
        if name in NUMBER_FIELDS:
            wrong = wrong | (F.col(name).isNotNull() & ~is_finite(F.col(name)))
        return F.when(wrong, F.lit(name)).otherwise(F.lit(""))

    keys = F.json_object_keys("_raw")
    unknown = F.get(F.array_except(keys, F.array(*[F.lit(name) for name in S.SCHEMA_FIELDS])), F.lit(0))
    wrong = F.get(F.array_intersect(keys, F.array(*[mistyped(name) for name in S.SCHEMA_FIELDS])), F.lit(0))
    place = lambda key: F.array_position(keys, key)
    return F.when(wrong.isNull() | (place(unknown) < place(wrong)), unknown).otherwise(wrong)


def parse_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode JSON texts into nullable typed columns; `shape` tells what is wrong with the text itself.

    `shape` is NULL for a readable record, '' for other JSON than an object, '?' for unreadable text, else the
    offending key. Only ill-shaped records pay for the search for the offender.
    """
    kept = [c for c in df.columns if c != raw]
    typed = once(
        df.select(*kept, F.col(raw).alias("_raw"), F.try_parse_json(F.col(raw)).alias("_v")),
        schema_version=_field("schema_version", "bigint"),
        event_id=_field("event_id", "string"),
        device_id=_field("device_id", "string"),
        event_time=_field("event_time", "string"),
        sequence=_field("sequence", "bigint"),
        temperature_c=_field("temperature_c", "double"),
        vibration_mm_s=_field("vibration_mm_s", "double"),
        site_id=_field("site_id", "string"),
        _types=F.schema_of_variant("_v"),
    )
    finite = reduce(lambda a, b: a & b, [is_finite(F.col(n)) | F.col(n).isNull() for n in NUMBER_FIELDS])
    shape = (
        F.when(F.col("_types").isNull(), F.lit("?"))
        .when(F.col("_types").rlike(WELL_SHAPED) & finite, F.lit(None).cast("string"))
        .when(~F.col("_types").startswith("OBJECT"), F.lit(""))
        .otherwise(_first_offender())
    )
    return once(typed, shape=shape).drop("_raw", "_v", "_types")


def _number(value: float) -> str:
    return f"{value:g}"


def rules(limits: Limits) -> list[tuple[Column, str, Column | str]]:
    """The ordered rules as (failed?, reason, detail). A failed comparison with NULL is not a failure."""
    missing = {name: F.col(name).isNull() for name in S.SCHEMA_FIELDS}
    required = {name: (missing[name], "missing_field", f"{name} is required") for name in S.SCHEMA_FIELDS}
    temp, vib = F.col("temperature_c"), F.col("vibration_mm_s")

    def bad_id(name: str) -> tuple[Column, str, str]:
        return ~is_identifier(F.col(name)), f"invalid_{name}", f"{name} must match {S.ID_RULE}"

    return [
        (F.col("shape") == "?", "malformed_json", S.DETAIL_SHAPE),
        (
            F.col("shape").isNotNull() & ~F.col("shape").isin("", *S.SCHEMA_FIELDS),
            "unknown_field",
            S.DETAIL_UNKNOWN,
        ),
        (
            F.col("shape").isNotNull(),
            "malformed_json",
            F.concat(F.lit('field "'), F.col("shape"), F.lit('" has the wrong JSON type')),
        ),
        required["schema_version"],
        (
            F.col("schema_version") != S.SCHEMA_VERSION,
            "unsupported_schema_version",
            f"schema_version must be {S.SCHEMA_VERSION}",
        ),
        required["event_id"],
        bad_id("event_id"),
        required["device_id"],
        bad_id("device_id"),
        required["event_time"],
        (F.col("_t").isNull(), "invalid_timestamp", S.DETAIL_TIME_FORMAT),
        (~in_supported_years(F.col("_t")), "invalid_timestamp", S.DETAIL_TIME_YEAR),
        (
            F.col("_t") > F.col("received_at") + F.expr(f"interval {limits.max_future_skew_s} seconds"),
            "time_in_future",
            S.DETAIL_TIME_FUTURE,
        ),
        required["temperature_c"],
        required["vibration_mm_s"],
        (
            ~is_finite(temp) | (temp < limits.temp_min_c) | (temp > limits.temp_max_c),
            "out_of_range",
            f"temperature_c must be finite and within [{_number(limits.temp_min_c)}, {_number(limits.temp_max_c)}]",
        ),
        (
            ~is_finite(vib) | (vib < 0) | (vib > limits.vib_max_mm_s),
            "out_of_range",
            f"vibration_mm_s must be finite and within [0, {_number(limits.vib_max_mm_s)}]",
        ),
        (F.col("sequence") < 0, "invalid_sequence", S.DETAIL_SEQUENCE),
        bad_id("site_id"),
    ]


def check_records(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Apply the rules to decoded columns; adds `reason` and `detail`, and turns event_time into an instant.

    Needs the schema fields plus `received_at`; `shape` is optional (typed input has no text to misread).
    """
    if "shape" not in df.columns:
        df = df.withColumn("shape", F.lit(None).cast("string"))
    chain = rules(limits)
    failed = reduce(
        lambda case, item: case.when(item[1][0], F.lit(item[0])),
        list(enumerate(chain))[1:],
        F.when(chain[0][0], F.lit(0)),
    )
    reasons = F.array(*[F.lit(reason) for _, reason, _ in chain])
    details = F.array(*[F.lit(d) if isinstance(d, str) else d for _, _, d in chain])
    kept = [c for c in df.columns if c not in (*S.SCHEMA_FIELDS, "shape", "received_at")]
    ruled = once(once(df, _t=parse_rfc3339(F.col("event_time"))), _rule=failed)
    return ruled.select(
        *kept,
        "event_id",
        "device_id",
        "site_id",
        F.col("schema_version").try_cast("int").alias("schema_version"),
        F.col("_t").alias("event_time"),
        "received_at",
        "sequence",
        "temperature_c",
        "vibration_mm_s",
        F.get(reasons, F.col("_rule")).alias("reason"),
        F.get(details, F.col("_rule")).alias("detail"),
    )


def validate(df: DataFrame, limits: Limits = Limits(), raw: str = "raw") -> DataFrame:
    """Decode and check JSON texts (V1-V11). Every input row comes back once."""
    return check_records(parse_records(df, raw), limits)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason", "detail")


def rejections(checked: DataFrame) -> DataFrame:
    """Dead-letter rows: position, reason and fixed text, never the payload."""
    lineage = [c for c in ("batch_id", "idx", "row_no") if c in checked.columns]
    return checked.where(F.col("reason").isNotNull()).select(*lineage, "reason", "detail", "received_at")


def zero_filled(counts: DataFrame, key: str, values: list[str], count: str = "n") -> DataFrame:
    """Counts over a closed set: every member appears, unseen ones with zero. The set is a short literal list."""
    spark = counts.sparkSession
    closed = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    return closed.join(counts, key, "left").select(key, F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias(count))


def rejection_counts(checked: DataFrame) -> DataFrame:
    """Rejected rows per reason, the closed set zero-filled."""
    counts = checked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    return zero_filled(counts, "reason", S.REASONS)


def batch_response(checked: DataFrame, batch: str = "batch_id", shown: int = S.MAX_REPORTED_REJECTIONS) -> DataFrame:
    """One answer per batch (V14): totals, counts by reason and the first rejections by position.

    The limit on shown rejections is applied before the shuffle, so a batch never gathers more than that per task.
    """
    totals = checked.groupBy(batch).agg(
        F.count("*").alias("received"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )
    bad = checked.where(F.col("reason").isNotNull())
    by_reason = (
        bad.groupBy(batch, "reason")
        .agg(F.count("*").alias("n"))
        .groupBy(batch)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejection_counts"))
    )
    first = (
        bad.select(batch, "idx", "reason", "detail")
        .withColumn("_r", F.row_number().over(Window.partitionBy(batch).orderBy("idx")))
        .where(F.col("_r") <= shown)
        .groupBy(batch)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "reason", "detail"))).alias("rejections"))
    )
    return (
        totals.join(by_reason, batch, "left")
        .join(first, batch, "left")
        .withColumn("rejections_truncated", F.col("rejected") > shown)
        .withColumn("status", F.lit(202))
    )
