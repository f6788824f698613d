"""Telemetry views over the driver tables.

The `events` table is clean, so faults are added by arithmetic on its columns: every fault below has the same
definition in SQL (see `oracle.py`). Everything is a projection of `events`, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.operators.dedup import dedup_in_batch, insert_new
from plantpulse.operators.validate import accepted, parse_records, validate
from plantpulse.session import pin, prepare

RECORD_FIELDS = [
    "schema_version", "event_id", "device_id", "event_time", "sequence", "temperature_c", "vibration_mm_s", "site_id",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _instant_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events as clean reading columns."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        n.alias("n"),
        F.concat(F.lit("ev-"), F.lpad(n.cast("string"), 12, "0")).alias("event_id"),
        F.concat(F.lit("dev-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("device_id"),
        F.col("user_id").alias("user_id"),
        F.col("ts").cast("timestamp").alias("t"),
        F.when(n % 10 != 0, n).alias("sequence"),
        F.col("value").alias("temperature_c"),
        (_k() / 10.0).alias("vibration_mm_s"),
        F.col("event_type").alias("site_id"),
        _k().alias("k"),
        (n / 500).cast("bigint").alias("batch_no"),
        (n % 500).cast("int").alias("idx"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean typed readings as a store would hold them."""
    s = source(spark, sf_dir)
    return s.select(
        "event_id",
        "device_id",
        "site_id",
        F.lit(1).alias("schema_version"),
        F.col("t").alias("event_time"),
        (F.col("t") + F.make_dt_interval(secs=F.col("k") * F.lit(0.05))).alias("received_at"),
        "sequence",
        "temperature_c",
        "vibration_mm_s",
        F.col("batch_no").cast("string").alias("batch_id"),
        "idx",
        F.col("n"),
    )


def dirty(spark: SparkSession, sf_dir: str, silence: bool = False) -> DataFrame:
    """Record columns with faults, before they become JSON text: `kind` 0..13 is a malformed record, NULL a good one.

    Also: days with a stuck temperature, readings one hour late, and copies that collide on the event id, on the
    sequence, on both, and in a chain; with `silence`, as the device report needs, no readings of some devices for days.
    """
    s = source(spark, sf_dir)
    day = F.dayofmonth("t")
    if silence:
        s = s.where(~((F.col("user_id") % 25 == 0) & day.between(18, 24)))
    s = s.withColumn(
        "temperature_c",
        F.when((F.col("user_id") % 15 == 0) & day.between(5, 16), F.lit(50.0)).otherwise(F.col("temperature_c")),
    )
    s = s.withColumn("kind", F.when(F.col("n") % 47 < 14, (F.col("n") % 47).cast("int")))
    s = s.withColumn("received_at", F.col("t") + F.make_dt_interval(secs=F.col("k") * F.lit(0.05)))
    s = s.withColumn(
        "event_time",
        F.when(F.col("kind") == 8, F.col("t") + F.expr("interval 1 hour"))
        .when(F.col("kind").isNull() & (F.col("n") % 30 == 7), F.col("t") - F.expr("interval 1 hour"))
        .otherwise(F.col("t")),
    )
    n, good = F.col("n"), F.col("kind").isNull()

    def copy(when: Column, no: int, event_id: Column, sequence: Column, batches: int, idx: int) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(no).alias("copy_no"),
                event_id.alias("event_id"),
                sequence.alias("sequence"),
                (F.col("batch_no") + batches).alias("batch_no"),
                (F.col("idx") + idx).alias("idx"),
            ),
        )

    same_id, same_seq = F.col("event_id"), F.col("sequence")
    chain = F.concat(F.lit("chain-"), n.cast("string"))
    fresh_seq = n + 10_000_000
    copies = (
        F.array(
            copy(F.lit(True), 0, same_id, same_seq, 0, 0),
            copy(good & (n % 40 == 3), 1, same_id, same_seq, 1, 1000),
            copy(good & (n % 55 == 4), 2, F.concat(F.lit("alt-"), n.cast("string")), same_seq, 0, 1500),
            copy(good & (n % 70 == 5), 3, same_id, same_seq, 0, 2000),
            copy(good & (n % 60 == 11), 4, chain, same_seq, 0, 3000),
            copy(good & (n % 60 == 11), 5, chain, fresh_seq, 0, 4000),
            copy(good & (n % 60 == 11), 6, F.concat(F.lit("tail-"), n.cast("string")), fresh_seq, 0, 5000),
        )
    )
    kept = [c for c in s.columns if c not in ("event_id", "sequence", "batch_no", "idx")]
    rows = s.select(*kept, F.inline(copies)).where(F.col("copy_no").isNotNull())
    return rows.withColumn("row_no", F.col("n") * 10 + F.col("copy_no") + 1)


def dirty_json(spark: SparkSession, sf_dir: str, silence: bool = False) -> DataFrame:
    """The dirty records as JSON texts with their place in a request: batch_id, idx, row_no, received_at, raw."""
    d = dirty(spark, sf_dir, silence)
    kind = F.col("kind")
    is_kind = lambda i: F.coalesce(kind == i, F.lit(False))
    text = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    parts = F.concat_ws(
        ",",
        F.concat(F.lit('"schema_version":'), F.when(is_kind(4), "99").otherwise("1")),
        F.concat(F.lit('"event_id":'), text(F.when(is_kind(5), "bad id!").otherwise(F.col("event_id")))),
        F.concat(F.lit('"device_id":'), text(F.when(is_kind(9), "press/01").otherwise(F.col("device_id")))),
        F.concat(
            F.lit('"event_time":'),
            text(F.when(is_kind(3), "not-a-timestamp").otherwise(_instant_text(F.col("event_time")))),
        ),
        F.concat(F.lit('"sequence":'), F.when(is_kind(7), "-1").otherwise(F.col("sequence").cast("string"))),
        F.when(
            ~is_kind(0),
            F.concat(
                F.lit('"temperature_c":'),
                F.when(is_kind(1), '"hot"').when(is_kind(2), "9999.0").otherwise(F.col("temperature_c").cast("string")),
            ),
        ),
        F.when(~is_kind(13), F.concat(F.lit('"vibration_mm_s":'), F.when(is_kind(12), "-1.0").otherwise(F.col("vibration_mm_s").cast("string")))),
        F.concat(F.lit('"site_id":'), text(F.when(is_kind(10), "plant a").otherwise(F.col("site_id")))),
        F.when(is_kind(6), F.lit('"received_at":"2024-01-01T00:00:00Z"')),
    )
    whole = F.concat(F.lit("{"), parts, F.when(is_kind(11), "").otherwise("}"))
    return d.select(
        F.col("batch_no").cast("string").alias("batch_id"),
        F.col("idx").cast("int").alias("idx"),
        "row_no",
        "received_at",
        whole.alias("raw"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty records as request bodies, one per batch (a batch holds at most a few hundred records).

    The truncated records would make a whole body unreadable, so a bare number stands in their place.
    """
    rows = dirty_json(spark, sf_dir).withColumn("raw", F.when(F.col("raw").endswith("}"), F.col("raw")).otherwise("42"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw"))), lambda x: x["raw"])
    body = F.concat(F.lit('{"events":['), F.array_join(items, ","), F.lit("]}"))
    return rows.groupBy("batch_id").agg(F.max("received_at").alias("received_at"), body.alias("body"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(dirty_json(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked records with the repeats inside a batch refused."""
    return pin(dedup_in_batch(checked(spark, sf_dir)))


def earlier_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that already holds the clean readings of two sites."""
    return readings(spark, sf_dir).where(F.col("site_id").isin("click", "view"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted records against the earlier store, in arrival order (batch, then position)."""
    rows = pin(accepted(deduped(spark, sf_dir)).withColumn("_batch", F.col("batch_id").cast("bigint")))
    return insert_new(rows, earlier_store(spark, sf_dir), ["_batch", "idx"]).drop("_batch")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live messages: each clean reading and the alerts it raised, at the reading's place in the stream."""
    r = readings(spark, sf_dir)
    events = r.select(
        F.col("n").alias("offset"), F.lit("event").alias("type"), "device_id", "event_id", "event_time",
        "temperature_c", "vibration_mm_s", F.lit(None).cast("string").alias("rule"),
    )
    hits = F.array(
        F.when(F.col("temperature_c") >= 85.0, F.lit("temperature_high")), F.when(F.col("vibration_mm_s") >= 7.1, F.lit("vibration_high"))
    )
    alerts = events.where(F.col("type") == "event").select(
        "offset", F.lit("alert").alias("type"), "device_id", "event_id", "event_time", "temperature_c", "vibration_mm_s",
        F.explode(hits).alias("rule"),
    ).where(F.col("rule").isNotNull())
    return events.unionByName(alerts)


def imported(spark: SparkSession, sf_dir: str, silence: bool = False) -> DataFrame:
    """The dirty records as an import sees them: raw time text, numbers where the value is one."""
    return parse_records(dirty_json(spark, sf_dir, silence))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imported rows with days of silence, as a written table: the report reads them several times, the JSON is
    decoded once."""
    return pin(imported(spark, sf_dir, silence=True))


def finished_micros(n: Column) -> Column:
    """When the attempt of an event ended."""
    return F.lit(1_704_067_200_000_000) + F.floor(n / 2500) * 3_600_000_000 + F.floor((n % 2500) / 10) * 1_000_000 + (n % 10) * 97_000


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery log: one attempt per driver event, 2500 attempts a run, ten a second; written like a real log."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    pair = (n / 2).cast("bigint")
    status = (
        F.when((F.col("event_type") == "error") & (n % 4 == 0), F.lit(None))
        .when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "signup", 429)
        .when(F.col("event_type") == "view", 503)
        .otherwise(202)
        .cast("int")
    )
    own = e.select(n.alias("n"), pair.alias("pair"), status.alias("status"), F.col("value"), _k().alias("k"))
    # The second event of a pair is a retry of the first when the first was told to slow down.
    pairs = own.groupBy("pair").agg(
        F.sort_array(F.collect_list(F.struct("n", "status", "value", "k"))).alias("p")
    )
    first_refused = F.coalesce(F.get("p", F.lit(0))["status"].isin(429, 503), F.lit(False))
    retry = first_refused & (F.size("p") == 2)
    rows = pairs.select("pair", retry.alias("retry"), F.posexplode("p").alias("pos", "a")).select(
        "pair", "retry", "pos", "a.*"
    )
    n_records = (1 + F.col("pair") % 50).cast("int")
    finished = F.timestamp_micros(finished_micros(F.col("n")))
    external = F.floor(F.col("n") / 2500) % 2 == 1
    rejected = F.least(n_records, (F.col("pair") % 3).cast("int"))
    log = rows.select(
        F.concat(F.lit("run-"), F.lpad(F.floor(F.col("n") / 2500).cast("string"), 5, "0")).alias("run_id"),
        (F.when(F.col("retry"), F.col("pair") * 2).otherwise(F.col("n")) % 2500).cast("int").alias("batch_no"),
        F.when(F.col("retry"), F.col("pos")).otherwise(0).cast("int").alias("attempt_no"),
        (finished - F.make_dt_interval(secs=F.col("value") / F.lit(1000.0))).alias("started_at"),
        finished.alias("finished_at"),
        n_records.alias("n_records"),
        "status",
        F.when(F.col("status").isNull(), F.lit("connection refused")).alias("error"),
        F.when(F.col("status") == 500, F.concat(F.lit("upstream\t"), F.col("k").cast("string"), F.lit("  failed\n"))).alias(
            "body"
        ),
        external.alias("external"),
        (F.col("pair") % 4 != 0).alias("is_ack"),
        F.when(F.col("status") == 202, n_records - rejected).otherwise(0).cast("int").alias("ack_accepted"),
        F.when(F.col("status").isin(202, 429, 503), rejected).otherwise(0).cast("int").alias("ack_rejected"),
        F.when(
            F.col("status").isin(202, 429, 503) & (rejected > 0), F.create_map(F.lit("missing_field"), rejected)
        ).alias("ack_rejection_counts"),
        (F.col("retry") & (F.col("pos") == 0)).alias("will_retry"),
    )
    return pin(log)


def runs(log: DataFrame) -> DataFrame:
    """One row per run of a log."""
    number = F.substring("run_id", 5, 10).cast("int")
    started = F.timestamp_micros(F.lit(1_704_067_200_000_000) + number.cast("bigint") * 3_600_000_000)
    return (
        log.groupBy("run_id")
        .agg(
            F.max("finished_at").alias("_end"),
            F.sum(F.when(F.col("attempt_no") == 0, F.col("n_records")).otherwise(0)).alias("planned"),
            F.sum(F.when(F.col("attempt_no") == 0, 1).otherwise(0)).alias("batches"),
            F.max("external").alias("external"),
        )
        .select(
            "run_id",
            F.lit("done").alias("state"),
            F.lit("generated data").alias("source"),
            F.concat(F.lit("http://user:pw@host-"), number.cast("string"), F.lit(":8080/api?key=1")).alias("target"),
            "external",
            started.alias("started_at"),
            ((F.unix_micros("_end") - F.unix_micros(started)) / 1e6).alias("elapsed_s"),
            F.col("planned").cast("int").alias("planned"),
            F.col("batches").cast("int").alias("batches"),
            F.lit(
                '{"rate_per_s":0,"ramp_to_per_s":0,"ramp_s":0,"speed":0,"batch_size":50,"concurrency":8,"retries":1,'
                '"malformed_rate":0,"duplicate_rate":0,"late_rate":0,"burst_every":0,"burst_size":0}'
            ).alias("config"),
        )
    )


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric scrapes as text lines: one scrape per driver event, seven counters each, plus lines to skip."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    counter = lambda outcome, value, family: F.concat(
        F.lit(f'pulse_{family}_events_total{{outcome="{outcome}"}} '), value.cast("string")
    )
    lines = F.array(
        F.lit("# HELP pulse_queue_depth Records waiting."),
        F.concat(F.lit("pulse_queue_depth "), (_k() % 17).cast("string")),
        F.lit("pulse_queue_depth_limit 1000"),
        counter("accepted", n * 3, "ingest"),
        counter("rejected_invalid", F.floor(n / 7), "ingest"),
        counter("rejected_overload", F.floor(n / 11), "ingest"),
        counter("stored", n * 2, "processed"),
        counter("duplicate", F.floor(n / 5), "processed"),
        counter("failed", F.floor(n / 1000), "processed"),
    )
    return e.select(n.alias("t"), F.explode(lines).alias("line"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access log: route, code and seconds per driver event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("route"),
        F.when(F.col("event_id") % 19 == 0, 400).when(F.col("event_id") % 23 == 0, 429).otherwise(200).alias("code"),
        (F.col("value") / F.lit(1000.0)).cast(T.DoubleType()).alias("seconds"),
    )


def threshold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings log: on each day of the recording new limits hold from its first reading on."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t"))
    first = e.groupBy(F.to_date("t").alias("day")).agg(F.min("t").alias("valid_from"))
    day = F.dayofmonth("day")
    return first.select("valid_from", (F.lit(80.0) + day % 7).alias("temperature_c"), ((70 + day % 3) / F.lit(10.0)).alias("vibration_mm_s"))
