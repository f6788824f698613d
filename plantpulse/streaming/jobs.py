"""Structured Streaming form of ingest, alerting and the live views.

The operators are the batch ones. Uniqueness has no time limit, so it is kept by the stored tables and not by
streaming state. Each micro-batch writes only its own `epoch=` folders and ignores them when it reads the store: a
micro-batch that is run again after a crash replaces what it had written and finds the same rows new.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse import schemas as S
from plantpulse.operators.alerts import alert_counts, evaluate_alerts, evaluate_with_history
from plantpulse.operators.dedup import dedup_in_batch, insert_new, processed_outcomes, stored_rows
from plantpulse.operators.frames import live_frames
from plantpulse.operators.store import latest_per_device, recent_trend, with_date
from plantpulse.operators.validate import accepted, rejection_counts, rejections, validate
from plantpulse.schemas import Limits, Thresholds
from plantpulse.session import pin, prepare, remove_folder, written_numbers

LINE_SCHEMA = "batch_id string, idx int, received_at timestamp, raw string"
ARRIVAL = ["epoch", "received_at", "batch_id", "idx"]
TREND_COLUMNS = ["event_id", "device_id", "event_time", "temperature_c", "vibration_mm_s", "received_at", "epoch", "batch_id", "idx"]


@dataclass(frozen=True)
class Tables:
    """Where a stream keeps its tables; all under one folder."""

    base: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.base}/{name}"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A table written in epochs, or None while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition() or error):
            return None
        raise


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


STORED_EVENTS = _with(S.EVENT_SCHEMA, ("epoch", T.LongType()), ("event_date", T.DateType()))


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Record lines as they arrive in a folder; `max_files` bounds the intake of one micro-batch."""
    reader = prepare(spark).readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    line = F.from_json("value", LINE_SCHEMA)
    return reader.load(path).select(line.alias("r")).select("r.*")


def stream_ingest(spark: SparkSession, path: str, limits: Limits = Limits(), max_files: int | None = None) -> DataFrame:
    """Validated stream (T1): stateless, late rows pass like any other."""
    return validate(read_lines(spark, path, max_files), limits)


def threshold_history(spark: SparkSession, path: str) -> DataFrame:
    """The settings table (T7): its rows (valid_from, temperature_c, vibration_mm_s), before them the usual thresholds."""
    usual = Thresholds()
    first = spark.range(1).select(
        F.lit("0001-01-01 00:00:00").cast("timestamp").alias("valid_from"), F.lit(usual.temperature_c).alias("temperature_c"), F.lit(usual.vibration_mm_s).alias("vibration_mm_s")
    )
    return first.unionByName(spark.read.parquet(path).select(*first.columns))


def persist(
    batch: DataFrame,
    epoch: int,
    place: Tables,
    thresholds_path: str | None = None,
    limits: Limits = Limits(),
    horizon_days: int | None = None,
) -> None:
    """One micro-batch (T2): events first, then their alerts, then counters and live messages.

    Of repeats in a micro-batch the one that arrived first is stored: by `received_at`, then by request and place in it.
    A reading meets the thresholds that held when it arrived, also when the micro-batch is run again later.

    Every micro-batch reads the key columns of the whole store. `horizon_days` narrows that to the dates around the
    micro-batch; it is off by default because a repeat that carries another event time may then pass.
    """
    spark = batch.sparkSession
    put = lambda df, table: df.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
    # The micro-batch is decoded once: `dedup_in_batch` works on the written table.
    judged = pin(dedup_in_batch(validate(batch, limits)))
    store = read_table(spark, place.events, STORED_EVENTS)
    if store is not None:
        store = store.where(F.col("epoch") != epoch)
    if store is not None and horizon_days is not None:
        day = F.to_date("event_time")
        first, last = accepted(judged).agg(F.date_sub(F.min(day), horizon_days), F.date_add(F.max(day), horizon_days)).first()
        if first is not None:
            store = store.where(F.col("event_date").between(F.lit(first), F.lit(last)))
    good = accepted(judged).withColumn("_batch", F.col("batch_id").try_cast("bigint"))
    outcomes = pin(insert_new(good, store, ["received_at", "_batch", "batch_id", "idx"]).drop("_batch"))
    stored = stored_rows(outcomes).select(*S.EVENT_SCHEMA.fieldNames())
    with_date(stored).write.mode("overwrite").partitionBy("event_date").parquet(f"{place.events}/epoch={epoch}")
    alerts = evaluate_alerts(stored) if thresholds_path is None else evaluate_with_history(stored, threshold_history(spark, thresholds_path), "received_at")
    put(alerts, place.alerts)
    put(rejections(judged), place.rejections)
    put(batch_metrics(judged, outcomes, alerts), place.metrics)
    put(live_frames(stored, alerts), place.frames)
    update_trend(spark, stored, epoch, place)


def batch_metrics(judged: DataFrame, outcomes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counters of one micro-batch (T11): (metric, label, n)."""
    named = lambda df, metric, key: df.select(F.lit(metric).alias("metric"), F.col(key).alias("label"), "n")
    return (
        named(rejection_counts(judged), "validation_failures", "reason")
        .unionByName(named(processed_outcomes(outcomes), "processed_events", "outcome"))
        .unionByName(named(alert_counts(alerts), "alerts_created", "rule"))
    )


def update_trend(spark: SparkSession, stored: DataFrame, epoch: int, place: Tables) -> None:
    """Keep the newest readings per device (T6): the version before and the micro-batch make the next version.

    Versions are separate folders, so nothing is overwritten while it is read, and a repeated micro-batch starts
    from the same predecessor. Older versions than that are removed, so two are there at most.
    """
    fresh = stored.withColumn("epoch", F.lit(epoch).cast("bigint")).select(*TREND_COLUMNS)
    before = [v for v in written_numbers(spark, place.trend, "v") if v < epoch]
    if before:
        fresh = fresh.unionByName(spark.read.parquet(f"{place.trend}/v={before[-1]}").select(*TREND_COLUMNS))
    newest = Window.partitionBy("device_id").orderBy(*[F.col(c).desc() for c in ARRIVAL])
    top = fresh.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= S.TREND_POINTS).drop("_r")
    top.write.mode("overwrite").parquet(f"{place.trend}/v={epoch}")
    for v in before[:-1]:
        remove_folder(spark, f"{place.trend}/v={v}")


def trend_rows(spark: SparkSession, place: Tables) -> DataFrame:
    """The current version of the kept readings."""
    return spark.read.parquet(f"{place.trend}/v={written_numbers(spark, place.trend, 'v')[-1]}")


def live_latest(spark: SparkSession, place: Tables) -> DataFrame:
    return latest_per_device(trend_rows(spark, place), ARRIVAL, ["event_id", "event_time", "temperature_c", "vibration_mm_s"])


def live_trend(spark: SparkSession, place: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return recent_trend(trend_rows(spark, place), ARRIVAL, thresholds)


def run_ingest(
    spark: SparkSession,
    source: str,
    place: Tables,
    max_files: int | None = None,
    thresholds_path: str | None = None,
    limits: Limits = Limits(),
    until_empty: bool = True,
    horizon_days: int | None = None,
):
    """Start the ingest stream. `until_empty` processes what is there and stops."""
    lines = read_lines(spark, source, max_files)
    writer = lines.writeStream.foreachBatch(
        lambda batch, epoch: persist(batch, epoch, place, thresholds_path, limits, horizon_days)
    ).option("checkpointLocation", place.progress)
    if not until_empty:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedup_stateful(stream: DataFrame, ttl: str, time: str = "event_time", keys: list[str] | None = None) -> DataFrame:
    """Bounded-state alternative to the store (T4): a repeat that comes later than `ttl` passes."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys or ["event_id"])


def per_second_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per event-time second (T10), of a table or a stream; without a watermark late rows still count."""
    return rows.groupBy(F.window("event_time", "1 second").alias("w"), *(by or [])).agg(F.count("*").alias("n"))


#: Micro-batches whose counts are read one by one before they are merged.
MERGE_EPOCHS = 20


def count_seconds(batch: DataFrame, epoch: int, base: str) -> None:
    """Counts of one micro-batch beside those of others: counts add up, so no second has to be kept as state, and a row that
    comes late by any time adds to its second.

    A micro-batch that is run again replaces its own counts. After `MERGE_EPOCHS` they are merged into one table; what
    that was made of is removed at the merge after, so a merge can be run again.
    """
    spark = batch.sparkSession
    per_second_counts(batch).write.mode("overwrite").parquet(f"{base}/epoch={epoch}")
    merged = [v for v in written_numbers(spark, base, "merged") if v < epoch]
    last = merged[-1] if merged else -1
    if epoch - last < MERGE_EPOCHS:
        return
    counted_seconds(spark, base, epoch, last).write.mode("overwrite").parquet(f"{base}/merged={epoch}")
    for v in merged[:-1]:
        remove_folder(spark, f"{base}/merged={v}")
    for e in written_numbers(spark, base, "epoch"):
        if e <= last:
            remove_folder(spark, f"{base}/epoch={e}")


def counted_seconds(spark: SparkSession, base: str, upto: int | None = None, merged: int | None = None) -> DataFrame:
    """`w, n`: the last merged counts (or those up to `merged`) and the counts of the micro-batches behind them."""
    if merged is None:
        merged = max(written_numbers(spark, base, "merged"), default=-1)
    behind = [e for e in written_numbers(spark, base, "epoch") if e > merged and (upto is None or e <= upto)]
    paths = ([f"{base}/merged={merged}"] if merged >= 0 else []) + [f"{base}/epoch={e}" for e in behind]
    return spark.read.parquet(*paths).groupBy("w").agg(F.sum("n").alias("n"))


def run_per_second(spark: SparkSession, source: str, schema: str, base: str, max_files: int | None = None) -> DataFrame:
    """Count what is there per second."""
    reader = prepare(spark).readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    counts = f"{base}/seconds"
    writer = reader.parquet(source).writeStream.foreachBatch(lambda df, epoch: count_seconds(df, epoch, counts))
    writer.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return counted_seconds(spark, counts).select(F.col("w.start").alias("second"), "n")
