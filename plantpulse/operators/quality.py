"""Data-quality report of imported readings.

Input rows carry `row_no` (file order, unique) and the record fields with the time as raw text and the measurements
as numbers (NULL when the cell held something else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.numbers import fixed_text, is_finite
from plantpulse.functions.text import counted, human_seconds, reason_label
from plantpulse.functions.times import format_ms, parse_rfc3339
from plantpulse.operators.ordered import PIECE, InOrder
from plantpulse.operators.ranks import select_ranks
from plantpulse.session import pin

MEASUREMENTS = ["temperature_c", "vibration_mm_s"]


def _score() -> Column:
    """What the device list is ordered by."""
    return F.col("gaps") + F.col("out_of_order") + F.col("stuck_runs")


def rejections_by_reason(checked: DataFrame, shown: int = S.MAX_REJECTION_EXAMPLES) -> DataFrame:
    """Per reason: rows, label and the first examples in file order (R1). Only the examples of a task are shuffled."""
    bad = checked.where(F.col("reason").isNotNull())
    counts = bad.groupBy("reason").agg(F.count("*").alias("n"))
    examples = (
        bad.select("reason", "row_no", "detail")
        .withColumn("_r", F.row_number().over(Window.partitionBy("reason").orderBy("row_no")))
        .where(F.col("_r") <= shown)
        .groupBy("reason")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("row_no").alias("row"), "detail"))).alias("examples"))
    )
    return counts.join(examples, "reason").select("reason", reason_label(F.col("reason")).alias("label"), "n", "examples")


def rejection_examples(checked: DataFrame, shown: int = S.MAX_REJECTION_EXAMPLES) -> DataFrame:
    """The examples of R1 as flat rows."""
    return rejections_by_reason(checked, shown).select(
        "reason", "label", "n", F.posexplode("examples").alias("pos", "e")
    ).select("reason", "label", "n", (F.col("pos") + 1).alias("example"), "e.row", "e.detail")


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the first of each key. Counted, not listed: copies combine before the shuffle."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("repeats"))


def duplicate_ids(rows: DataFrame, derived_ids: bool = False) -> DataFrame:
    """Rows whose event_id an earlier row used (R2); none when the ids were made up from row numbers."""
    named = rows.where((F.col("event_id") != "") & F.lit(not derived_ids))
    return _repeats(named, ["event_id"]).agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_ids"))


def duplicate_readings(rows: DataFrame) -> DataFrame:
    """Per device, rows whose device and raw time text an earlier row used."""
    timed = rows.where((F.col("device_id") != "") & (F.col("event_time") != ""))
    return (
        _repeats(timed, ["device_id", "event_time"])
        .groupBy("device_id")
        .agg(F.sum("repeats").alias("duplicate_readings"))
    )


def value_stats(rows: DataFrame) -> DataFrame:
    """Count, smallest, largest and mean of each measurement over the rows that hold a finite number."""
    part = lambda f, m: f(F.when(is_finite(F.col(m)), F.col(m)))
    wide = rows.agg(
        *[
            F.struct(
                F.lit(m).alias("field"), part(F.count, m).alias("n"), part(F.min, m).alias("min_value"),
                part(F.max, m).alias("max_value"), part(F.avg, m).alias("mean_value"),
            ).alias(m)
            for m in MEASUREMENTS
        ]
    )
    return wide.select(F.inline(F.array(*MEASUREMENTS))).where(F.col("n") > 0)


def _device_rows(rows: DataFrame) -> DataFrame:
    t = F.unix_micros(parse_rfc3339(F.col("event_time")))
    timed = F.col("t").isNotNull()
    return (
        rows.where(F.col("device_id") != "")
        .select("device_id", "row_no", t.alias("t"), *MEASUREMENTS)
        .select(
            "device_id",
            "row_no",
            "t",
            *[F.when(timed & is_finite(F.col(m)), F.col(m)).alias(m) for m in MEASUREMENTS],
        )
    )


#: File rows whose order is looked at together; larger numbers make fewer, larger groups.
ROW_BLOCK = 1 << 20


def _late_rows(rows: DataFrame, block: int) -> DataFrame:
    """Per device, rows older than an earlier row of the file.

    A device is cut into blocks of row numbers; the latest time of the blocks before enters as one value per block.
    """
    cut = rows.select("device_id", "row_no", "t", F.floor(F.col("row_no") / block).alias("_block"))
    inside = Window.partitionBy("device_id", "_block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("device_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.groupBy("device_id", "_block").agg(F.max("t").alias("_t")).withColumn("_earlier", F.max("_t").over(across))
    seen = cut.withColumn("_latest", F.max("t").over(inside)).join(edges, ["device_id", "_block"])
    late = F.col("t") < F.greatest("_latest", "_earlier")
    return seen.groupBy("device_id").agg(F.count_if(late).alias("out_of_order"))


def _facts(ordered: InOrder) -> DataFrame:
    """What the report needs of rows in time order, counted inside each piece.

    `kind` 0 has a row per spacing between neighbours (`key`, NULL where there is none above zero). Each measurement has
    a kind of its own, with a row per run of one value: all long ones, and the first and last of the piece, `edge`, which
    may go on in the next one.
    """
    over = ordered.window()
    step = F.col("t") - F.lag("t").over(over)
    starts = {m: F.coalesce(F.col(m) != F.lag(m).over(over), F.lit(True)).cast("int").alias(f"_start_{m}") for m in MEASUREMENTS}
    begun = ordered.df.select("*", F.when(step > 0, step).alias("_step"), *starts.values())
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = begun.select("*", *[F.sum(f"_start_{m}").over(upto).alias(f"_run_{m}") for m in MEASUREMENTS])
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), value.alias("value"))
    entries = [entry(0, "_step", F.lit(None).cast("double")), *[entry(i, f"_run_{m}", F.col(m)) for i, m in enumerate(MEASUREMENTS, 1)]]
    counted = runs.select(*ordered.keys, "t", F.inline(F.array(*entries))).groupBy(*ordered.keys, "kind", "key").agg(
        F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.first("value").alias("value")
    )
    last = F.max("key").over(Window.partitionBy(*ordered.keys, "kind"))
    edge = (F.col("kind") > 0) & ((F.col("key") == 1) | (F.col("key") == last))
    long = (F.col("n") >= S.STUCK_RUN_LENGTH) & F.col("value").isNotNull()
    return pin(counted.withColumn("edge", edge).where((F.col("kind") == 0) | F.col("edge") | long))


def _steps_between_pieces(ordered: InOrder) -> DataFrame:
    place = F.struct(*ordered.order)
    ends = ordered.df.groupBy(*ordered.keys).agg(F.min_by("t", place).alias("_first"), F.max_by("t", place).alias("_last"))
    step = F.col("_first") - F.lag("_last").over(Window.partitionBy("device_id").orderBy(PIECE))
    return ends.select("device_id", step.alias("step"), F.lit(1).cast("bigint").alias("n")).where("step > 0")


def _stuck(facts: DataFrame) -> DataFrame:
    """Per device, runs of at least `STUCK_RUN_LENGTH` equal values; those at the edges of pieces are joined to their neighbours."""
    runs = facts.where("kind > 0")
    order = Window.partitionBy("device_id", "kind").orderBy(PIECE, "key")
    apart = (F.lag(PIECE).over(order) == F.col(PIECE)) | (F.lag("value").over(order) != F.col("value"))
    begins = F.coalesce(apart, F.lit(True)).cast("int")
    edges = runs.where("edge").withColumn("_begins", begins)
    grouped = edges.withColumn("_group", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = grouped.groupBy("device_id", "kind", "_group").agg(F.sum("n").alias("n"), F.first("value").alias("value"))
    whole = joined.where((F.col("n") >= S.STUCK_RUN_LENGTH) & F.col("value").isNotNull()).select("device_id")
    return whole.unionByName(runs.where("NOT edge").select("device_id")).groupBy("device_id").agg(F.count("*").alias("stuck_runs"))


def device_report(rows: DataFrame, pieces: int | None = None, block: int = ROW_BLOCK) -> DataFrame:
    """One row per device: rows, first and last time, disorder, usual spacing, gaps and stuck runs.

    The rows are put into time order once, in pieces, so one device may hold most of them.
    """
    timed = _device_rows(rows)
    ordered = InOrder(timed, ["device_id"], ["t", "row_no"], pieces)
    facts = _facts(ordered)
    spacing = facts.where("kind = 0")
    totals = spacing.groupBy("device_id").agg(F.sum("n").alias("rows"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))
    steps = spacing.where("key IS NOT NULL").select("device_id", F.col("key").alias("step"), "n").unionByName(_steps_between_pieces(ordered))
    steps = steps.groupBy("device_id", "step").agg(F.sum("n").alias("n"))
    # The usual spacing holds index n/2 of all positive ones in rising order; there have to be enough of them.
    sizes = steps.groupBy("device_id").agg(F.sum("n").alias("_all")).where(F.col("_all") >= S.MIN_INTERVALS_FOR_GAP)
    middle = sizes.select("device_id", (F.floor(F.col("_all") / 2) + 1).alias("rank"))
    usual = select_ranks(steps.withColumnRenamed("step", "value"), middle, ["device_id"]).select("device_id", F.col("value").alias("usual"))
    gaps = steps.join(usual, "device_id").groupBy("device_id").agg(F.first("usual").alias("usual"), *_gap_columns())
    joined = totals.join(_late_rows(ordered.df, block), "device_id").join(gaps, "device_id", "left").join(_stuck(facts), "device_id", "left")
    return _report_columns(joined.withColumn("stuck_runs", F.coalesce("stuck_runs", F.lit(0))))


def _gap_columns() -> list[Column]:
    gap = F.col("step") > F.col("usual") * S.GAP_FACTOR
    return [
        F.sum(F.when(gap, F.col("n")).otherwise(0)).alias("gaps"),
        F.max(F.when(gap, F.col("step"))).alias("longest"),
    ]


def _report_columns(df: DataFrame) -> DataFrame:
    seconds = lambda c: F.coalesce(F.col(c) / 1e6, F.lit(0.0))
    time = lambda c: format_ms(F.timestamp_micros(c))
    return df.select(
        F.col("device_id").alias("device"),
        F.col("rows").cast("bigint").alias("rows"),
        time("first_t").alias("first_time"),
        time("last_t").alias("last_time"),
        seconds("usual").alias("usual_interval_seconds"),
        seconds("longest").alias("longest_gap_seconds"),
        F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
        F.col("out_of_order").cast("bigint").alias("out_of_order"),
        F.col("stuck_runs").cast("bigint").alias("stuck_runs"),
    )


def usual_interval(report: DataFrame) -> DataFrame:
    """Devices with enough spacings to have a usual one."""
    return report.where(F.col("usual_interval_seconds") > 0).select("device", "usual_interval_seconds")


def gaps(report: DataFrame) -> DataFrame:
    """Devices with unusually long silences."""
    return report.where(F.col("gaps") > 0).select("device", "gaps", "longest_gap_seconds", "usual_interval_seconds")


def stuck_runs(report: DataFrame) -> DataFrame:
    """Devices with runs of one repeated value."""
    return report.where(F.col("stuck_runs") > 0).select("device", "stuck_runs")


def out_of_order(report: DataFrame) -> DataFrame:
    """Devices with rows older than an earlier row."""
    return report.where(F.col("out_of_order") > 0).select("device", "out_of_order")


def worst_devices(report: DataFrame, n: int = S.MAX_REPORT_DEVICES) -> DataFrame:
    """The devices with most findings."""
    return report.orderBy(_score().desc(), F.col("device").asc()).limit(n)


def report_totals(
    rows: DataFrame, checked: DataFrame, report: DataFrame, derived_ids: bool = False
) -> DataFrame:
    """One row of totals (R11). Each part is aggregated on its own and enters as a scalar."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    repeated = duplicate_readings(rows).agg(zero("duplicate_readings"))
    devices = report.agg(
        F.struct(
            zero("out_of_order").alias("out_of_order"),
            zero("gaps").alias("gaps"),
            zero("stuck_runs").alias("stuck_runs"),
            F.count("*").alias("devices_total"),
        )
    )
    counts = checked.agg(F.count("*").alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return counts.select(
        "rows",
        "rejected",
        duplicate_ids(rows, derived_ids).scalar().alias("duplicate_ids"),
        repeated.scalar().alias("duplicate_readings"),
        devices.scalar().alias("_d"),
    ).select("rows", "rejected", "duplicate_ids", "duplicate_readings", "_d.*")


def _worst_by(score: Column) -> Column:
    """struct of the device with the highest score; of equal ones the one with more findings, then the first by name."""
    return F.min_by(
        F.struct("device", "longest_gap_seconds", "usual_interval_seconds"),
        F.struct(-score, -_score(), F.col("device")),
    )


def findings(totals: DataFrame, reasons: DataFrame, report: DataFrame) -> DataFrame:
    """The report as ordered sentences (R12): one row of totals becomes at most six lines, or one `ok` line."""
    listed = report.agg(
        F.struct(
            _worst_by(F.col("longest_gap_seconds")).alias("gap"), _worst_by(F.col("stuck_runs")).alias("stuck")
        )
    )
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reason", "n", "label")))  # one per reason
    parts = reasons.agg(
        F.array_join(F.transform(entries, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["label"])), ", ")
    )
    facts = totals.select("*", parts.scalar().alias("parts"), listed.scalar().alias("_w")).select("*", "_w.*")
    n = lambda c: F.col(c).cast("string")
    line = lambda when, level, *text: F.when(
        when, F.struct(F.lit(level).alias("level"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("text"))
    )
    ids, readings, late, silent, stuck = (
        F.col(c) for c in ("duplicate_ids", "duplicate_readings", "out_of_order", "gaps", "stuck_runs")
    )
    share = fixed_text(100.0 * F.col("rejected") / F.col("rows"), 1)
    lines = F.array(
        line(
            F.col("rejected") > 0, "problem", n("rejected"), " of ", n("rows"), " rows (", share,
            "%) would be rejected by the schema checks: ", F.col("parts"), ".",
        ),
        line(
            ids > 0, "warning", n("duplicate_ids"), " ", counted(ids, "row has an", "rows have an"),
            " event_id already used by an earlier row. A service that ignores repeated ids will store ",
            counted(ids, "it", "them"), " once.",
        ),
        line(
            readings > 0, "warning", n("duplicate_readings"), " ", counted(readings, "row has", "rows have"),
            " the same device and time as an earlier row.",
        ),
        line(
            late > 0, "warning", n("out_of_order"), " ", counted(late, "row is", "rows are"),
            " older than an earlier row of the same device, so the file is not in time order for ",
            counted(late, "it", "them"), ".",
        ),
        line(
            silent > 0, "warning", n("gaps"), " unusually long ", counted(silent, "silence", "silences"),
            f" in the readings (more than {S.GAP_FACTOR} times the usual spacing). The longest is ",
            human_seconds(F.col("gap.longest_gap_seconds")), " on ", F.col("gap.device"),
            ", where readings usually come every ", human_seconds(F.col("gap.usual_interval_seconds")), ".",
        ),
        line(
            stuck > 0, "warning", n("stuck_runs"), " ", counted(stuck, "run", "runs"),
            f" of {S.STUCK_RUN_LENGTH} or more identical values in a row, which can mean a stuck sensor (most on ",
            F.col("stuck.device"), ").",
        ),
    )
    fine = F.array(
        F.struct(
            F.lit("ok").alias("level"),
            F.lit(
                "No problems found: every row passes the schema checks, no repeated rows, the times are in order "
                "and there are no long silences."
            ).alias("text"),
        )
    )
    kept = F.array_compact(lines)
    return facts.select(F.posexplode(F.when(F.size(kept) == 0, fine).otherwise(kept)).alias("pos", "f")).select(
        (F.col("pos") + 1).alias("line_no"), "f.level", "f.text"
    )
