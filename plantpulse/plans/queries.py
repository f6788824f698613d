"""The registered queries: every operator applied to the driver tables.

Times leave as text and computed doubles are rounded, so that results compare exactly across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.cursors import cursor_parts, cursor_token, encode_cursor
from plantpulse.functions.text import base_name, display_address, hide_header_values, saved_address
from plantpulse.functions.times import format_nano, instant, parse_rfc3339_text
from plantpulse.operators import alerts as A
from plantpulse.operators import dedup as D
from plantpulse.operators import frames as P
from plantpulse.operators import metrics as M
from plantpulse.operators import quality as R
from plantpulse.operators import rebase as B
from plantpulse.operators import runs as L
from plantpulse.operators import store as Q
from plantpulse.operators import validate as V
from plantpulse.operators.ordered import global_rank
from plantpulse.plans import views
from plantpulse.session import ensure_checkpoint_dir, pin
from plantpulse.sources import exports, mapping, readers
from plantpulse.streaming import jobs

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

BROWSE = Q.make_query(browse=True)
DAY = Q.make_query("2024-01-10T06:00:00Z", "2024-01-11T06:00:00Z", limit=100)


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def time_text(*names: str) -> dict[str, Column]:
    return {n: format_nano(F.col(n)) for n in names}


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- validation -------------------------------------------------------------
@query
def alert_counts_by_device(spark, d):
    return A.alert_counts_by_device(A.evaluate_alerts(V.accepted(views.checked(spark, d))))


@query
def validation_reasons(spark, d):
    return V.rejection_counts(views.checked(spark, d))


@query
def validation_reasons_with_duplicates(spark, d):
    return V.rejection_counts(views.deduped(spark, d))


@query
def validated_events(spark, d):
    good = V.accepted(views.checked(spark, d))
    return good.withColumns(time_text("event_time", "received_at"))


@query
def dead_letters(spark, d):
    return V.rejections(views.deduped(spark, d)).select("batch_id", "idx", "reason", "detail")


@query
def batch_response(spark, d):
    answers = V.batch_response(views.deduped(spark, d))
    counts = F.array_join(
        F.transform(F.map_entries("rejection_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    shown = F.array_join(
        F.transform("rejections", lambda e: F.concat(e["index"].cast("string"), F.lit(":"), e["reason"])), ","
    )
    return answers.select(
        "batch_id", "received", "accepted", "rejected", counts.alias("counts"), shown.alias("shown"), "rejections_truncated", "status"
    )


@query
def batch_envelopes(spark, d):
    return readers.batch_envelope(views.request_bodies(spark, d)).select("batch_id", "n_events", "status", "error", "detail")


@query
def payload_reasons(spark, d):
    """The way of a request: envelope, records in their original text, validation, repeats inside the batch.

    A request that is refused as a whole has its error for an outcome.
    """
    enveloped = readers.batch_envelope(views.request_bodies(spark, d))
    records = readers.explode_payload(readers.good_batches(enveloped))
    checked = D.dedup_in_batch(V.validate(records))
    outcomes = checked.groupBy("batch_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    return outcomes.unionByName(enveloped.where("error is not null").select("batch_id", F.col("error").alias("outcome"), F.lit(1).cast("bigint").alias("n")))


@query
def payload_shapes(spark, d):
    """Records of the same requests written in each of the accepted shapes, with those that are valid."""
    bodies = views.request_bodies(spark, d)
    items = F.from_json("body", "struct<events: array<string>>")["events"]
    texts = {
        "batch": F.col("body"), "array": F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), "ndjson": F.concat(F.array_join(items, "\n \n"), F.lit("\n")),
        "single": items[0],
    }
    counts = None
    for shape, text in texts.items():
        records = readers.explode_payload(bodies.select("batch_id", "received_at", text.alias("body")), shape)
        per = V.validate(records).groupBy(F.lit(shape).alias("shape")).agg(F.count("*").alias("records"), F.count_if(F.col("reason").isNull()).alias("valid"))
        counts = per if counts is None else counts.unionByName(per)
    return counts


@query
def envelope_faults(spark, d):
    """Requests with what can be wrong with one as a whole, in turn."""
    n = F.col("batch_id").cast("int") % 6
    body = F.when(n == 1, F.expr("left(body, length(body) - 2)")).when(n == 2, "{}").when(n == 3, F.concat("body", F.lit(" x"))).when(n == 4, '{"events":[]}')
    body = F.when(n == 5, F.concat("body", F.repeat(F.lit(" "), S.MAX_BODY_BYTES))).otherwise(F.coalesce(body, F.col("body")))
    judged = readers.batch_envelope(views.request_bodies(spark, d).withColumn("body", body))
    return judged.select("batch_id", "status", "error", "detail")


@query
def rejection_examples(spark, d):
    return R.rejection_examples(views.checked(spark, d))


# --- uniqueness -------------------------------------------------------------
@query
def dedup_in_batch(spark, d):
    return V.accepted(views.deduped(spark, d)).select("batch_id", "idx", "event_id", "device_id", "sequence")


@query
def insert_new(spark, d):
    return views.outcomes(spark, d).select("batch_id", "idx", "event_id", "outcome")


@query
def persist_outcomes(spark, d):
    return D.persist_outcomes(views.outcomes(spark, d))


@query
def processed_outcomes(spark, d):
    return D.processed_outcomes(views.outcomes(spark, d))


@query
def replay_idempotence(spark, d):
    """The clean readings sent again to a store that holds them: nothing new, no alert."""
    r = views.readings(spark, d)
    again = D.insert_new(r.drop("n"), r, ["batch_id", "idx"])
    return again.agg(
        F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate"),
        A.alerts_for_new(again).agg(F.count("*")).scalar().alias("alerts"),
    )


@query
def conservation_check(spark, d):
    checked = views.deduped(spark, d)
    rows = V.accepted(checked).withColumn("_batch", F.col("batch_id").cast("bigint"))
    return L.conservation_check(checked, D.insert_new(rows, views.earlier_store(spark, d), ["_batch", "idx"]))


# --- alerts -----------------------------------------------------------------
@query
def alerts_all(spark, d):
    return A.evaluate_alerts(views.readings(spark, d)).withColumns(time_text("event_time", "created_at"))


@query
def alerts_threshold_history(spark, d):
    r = views.readings(spark, d).withColumn("processed_at", F.col("received_at"))
    return A.evaluate_with_history(r, views.threshold_history(spark, d)).withColumns(time_text("event_time", "created_at"))


@query
def golden_alerts(spark, d):
    """Alerts of all readings against a list that leaves one site out and asks for a lower temperature at another."""
    r = views.readings(spark, d)
    at = F.when(F.col("site_id") == "view", 80.0).otherwise(85.0)
    listed = r.where("site_id <> 'click'").select("event_id", "device_id", F.explode(F.array(
        F.struct(F.lit("temperature_high").alias("rule"), at.alias("threshold"), F.col("temperature_c").alias("observed")),
        F.struct(F.lit("vibration_high").alias("rule"), F.lit(7.1).alias("threshold"), F.col("vibration_mm_s").alias("observed")),
    )).alias("x")).select("event_id", "device_id", "x.*").where("observed >= threshold")
    return A.golden_alerts(A.evaluate_alerts(r), listed.withColumn("alert_id", A.alert_id(F.col("event_id"), F.col("rule"))))


@query
def alerts_new_only(spark, d):
    return A.alerts_for_new(views.outcomes(spark, d)).select("alert_id", "device_id", "rule", "threshold", "observed")


@query
def merge_alerts(spark, d):
    old = A.evaluate_alerts(views.earlier_store(spark, d))
    new = A.evaluate_alerts(V.accepted(views.checked(spark, d)))
    return A.merge_alerts(new, old).select("alert_id", "event_id", "rule")


@query
def alert_counts(spark, d):
    return A.alert_counts(A.evaluate_alerts(views.readings(spark, d)))


# --- query surface ----------------------------------------------------------
EVENT_VIEW = ["event_id", "device_id", "site_id", "schema_version", "sequence", "temperature_c", "vibration_mm_s"]


@query
def events_page1(spark, d):
    return Q.page(views.readings(spark, d), DAY).select(*EVENT_VIEW, "next_cursor", format_nano(F.col("event_time")).alias("event_time"))


@query
def events_page_after_cursor(spark, d):
    """The page behind a position in the middle of the range."""
    cursor = encode_cursor(parse_rfc3339_text("2024-01-10T10:00:00Z"), "ev-0")
    q = Q.make_query("2024-01-10T06:00:00Z", "2024-01-11T06:00:00Z", limit=50, cursor=cursor)
    return Q.page(views.readings(spark, d), q).select(*EVENT_VIEW, "next_cursor", format_nano(F.col("event_time")).alias("event_time"))


@query
def events_of_device(spark, d):
    q = Q.make_query("2024-01-10T06:00:00Z", "2024-01-11T06:00:00Z", device_id="dev-00000008", limit=1000)
    return Q.page(views.readings(spark, d), q).select(*EVENT_VIEW, "next_cursor")


@query
def alerts_page(spark, d):
    page = Q.page(A.evaluate_alerts(views.readings(spark, d)), DAY, "alerts")
    return page.select("alert_id", "device_id", "rule", "threshold", "observed", "next_cursor", format_nano(F.col("event_time")).alias("event_time"))


@query
def cursor_tokens(spark, d):
    r = views.readings(spark, d).withColumn("token", cursor_token(F.col("event_time"), F.col("event_id")))
    back = r.withColumn("p", cursor_parts(F.col("token")))
    return back.select("event_id", "token", F.col("p.id").alias("decoded_id"), F.unix_micros("p.time").alias("decoded_us"))


@query
def walk_pages(spark, d):
    whole = Q.Query(BROWSE.start, BROWSE.end, None, 250)
    return Q.pages(views.readings(spark, d), whole).select("event_id", "page")


@query
def newest_alerts(spark, d):
    feed = Q.newest_alerts(A.evaluate_alerts(views.readings(spark, d)))
    return feed.select("alert_id", "rule", format_nano(F.col("created_at")).alias("created_at"))


@query
def run_history(spark, d):
    return Q.run_history(_log(spark, d)[1]).select("run_id", "state", format_nano(F.col("started_at")).alias("started_at"))


@query
def storage_stats(spark, d):
    r = views.readings(spark, d)
    return Q.storage_stats(r, A.evaluate_alerts(r)).withColumns(time_text("first_event", "last_event"))


@query
def device_counts(spark, d):
    return Q.device_counts(views.readings(spark, d))


@query
def latest_per_device(spark, d):
    latest = Q.latest_per_device(views.readings(spark, d), ["received_at", "event_id"], ["event_id", "event_time", "temperature_c", "vibration_mm_s"])
    return latest.withColumns(time_text("event_time"))


@query
def recent_trend(spark, d):
    trend = Q.recent_trend(views.readings(spark, d), ["received_at", "event_id"])
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return trend.withColumns({c: text(c) for c in ("temperature_values", "vibration_values")})


@query
def highlight_alerts(spark, d):
    r = views.readings(spark, d)
    latest = Q.latest_per_device(r, ["received_at", "event_id"], ["event_id", "temperature_c", "vibration_mm_s"])
    marked = Q.highlight_alerts(latest, A.evaluate_alerts(r))
    return marked.withColumns({c: F.array_join(c, ",") for c in ("fired", "marked")})


@query
def state_as_of(spark, d):
    """The live view at the middle of the recording."""
    m = views.messages(spark, d)
    middle = views.table(spark, d, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    state = Q.state_as_of(m, middle)["devices"]
    return state.select("device_id", "event_id", "temperature_c", F.coalesce(F.array_join("fired", ","), F.lit("")).alias("fired"))


@query
def states_as_of(spark, d):
    last = views.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return Q.states_as_of(views.messages(spark, d), [last // 10 * i for i in range(1, 11)])


# --- data-quality report ----------------------------------------------------
@query
def device_report(spark, d):
    return R.device_report(views.decoded(spark, d))


@query
def worst_devices(spark, d):
    return R.worst_devices(R.device_report(views.decoded(spark, d)))


@query
def usual_interval(spark, d):
    return R.usual_interval(R.device_report(views.decoded(spark, d)))


@query
def gaps(spark, d):
    return R.gaps(R.device_report(views.decoded(spark, d)))


@query
def stuck_runs(spark, d):
    return R.stuck_runs(R.device_report(views.decoded(spark, d)))


@query
def out_of_order(spark, d):
    return R.out_of_order(R.device_report(views.decoded(spark, d)))


@query
def duplicate_ids(spark, d):
    return R.duplicate_ids(views.imported(spark, d))


@query
def duplicate_readings(spark, d):
    return R.duplicate_readings(views.imported(spark, d))


@query
def value_stats(spark, d):
    return rounded(R.value_stats(views.imported(spark, d)), "mean_value")


@query
def report_totals(spark, d):
    rows = views.decoded(spark, d)
    return R.report_totals(rows, V.check_records(rows), R.device_report(rows))


@query
def findings(spark, d):
    rows = views.decoded(spark, d)
    checked, report = V.check_records(rows), pin(R.device_report(rows))
    return R.findings(R.report_totals(rows, checked, report), R.rejections_by_reason(checked), report)


# --- delivery log -----------------------------------------------------------
def _log(spark, d):
    log = views.attempts(spark, d)
    return log, views.runs(log)


@query
def record_outcomes(spark, d):
    cols = ["run_id", "batch_no", "attempt_no", "kind", "accepted", "rejected", "gave_up", "errored"]
    return L.record_outcomes(views.attempts(spark, d)).select(*cols)


@query
def run_totals(spark, d):
    return rounded(L.run_totals(*_log(spark, d)), "elapsed_s", "throughput_per_s")


@query
def rejection_totals(spark, d):
    return L.rejection_totals(views.attempts(spark, d))


@query
def status_counts(spark, d):
    return L.status_counts(views.attempts(spark, d))


@query
def latency_summary(spark, d):
    return L.latency_summary(views.attempts(spark, d))


@query
def first_error(spark, d):
    return L.first_error(views.attempts(spark, d))


@query
def timeline(spark, d):
    return L.timeline(*_log(spark, d))


@query
def timeline_summary(spark, d):
    return L.timeline_summary(L.timeline(*_log(spark, d)))


@query
def thin_timeline(spark, d):
    points = L.thin_timeline(L.timeline(*_log(spark, d)))
    return points.select("run_id", "t", "step", "requests", "sent", "records")


def _records(spark, d):
    log, runs = _log(spark, d)
    points = L.timeline(log, runs)
    return L.run_records(log, runs, points), points


@query
def run_records(spark, d):
    records, _ = _records(spark, d)
    kept = [
        "run_id", "id", "target", "planned", "records_done", "accepted", "rejected", "throttled", "retries", "request_errors",
        "p50_ms", "p95_ms", "p99_ms", "max_ms", "peak_sent_per_s", "peak_accepted_per_s", "first_throttled_at_s", "first_error_at_s",
    ]
    return records.select(*kept, F.col("first_error.message").alias("message"))


@query
def compare_runs(spark, d):
    records = pin(_records(spark, d)[0])  # one row per run, read as A and as B
    return L.compare_runs(records, L.run_pairs(records))


@query
def report_lines(spark, d):
    """The first run sends the dirty records, so its report ends with their data check."""
    records, points = _records(spark, d)
    first = F.lit("run-00000").alias("run_id")
    rows = views.imported(spark, d)
    data = rows.agg(first, F.lit("dirty|records").alias("name"), F.count("*").alias("rows"), F.count_distinct("device_id").alias("devices"))
    groups = R.rejection_examples(views.checked(spark, d)).select(first, "reason", "label", "n", "row", "detail")
    return L.report_lines(records, points, datasets=data, rejections=groups)


@query
def run_outcome(spark, d):
    """With the rows that each run stored: the growth of a counter that begins anew now and then, from scrape to scrape."""
    log, runs = _log(spark, d)
    stored = M.scrape_long(views.scrapes(spark, d)).where("metric = 'stored'")
    series = stored.select(views.finished_micros(F.col("t")).alias("t"), (F.col("value") % 9000).alias("value"))
    start = F.unix_micros("started_at")
    spans = runs.select("run_id", start.alias("from_t"), (start + F.round(F.col("elapsed_s") * 1e6)).cast("bigint").alias("to_t"))
    grown = M.growth_between(series, spans).select("run_id", F.col("growth").cast("bigint").alias("stored"))
    return L.run_outcome(L.run_totals(log, runs), runs, grown)


@query
def redacted_targets(spark, d):
    return _log(spark, d)[1].select("run_id", display_address(F.col("target")).alias("shown"), saved_address(F.col("target")).alias("saved"))


# --- counters ---------------------------------------------------------------
@query
def ingest_outcomes(spark, d):
    return M.ingest_outcomes(views.attempts(spark, d))


@query
def lag_histogram(spark, d):
    return rounded(M.histogram(M.source_lag(V.accepted(views.checked(spark, d))), "lag_s", S.LAG_BOUNDS), "total", digits=3)


@query
def lag_quantiles(spark, d):
    hist = M.histogram(M.source_lag(V.accepted(views.checked(spark, d))), "lag_s", S.LAG_BOUNDS)
    return rounded(M.histogram_quantile(hist, [0.5, 0.95, 0.99]), "value")


@query
def attempt_durations(spark, d):
    log = M.durations(views.attempts(spark, d), "started_at", "finished_at", "seconds")
    return rounded(M.histogram(log, "seconds", S.LATENCY_BOUNDS, ["run_id"]), "total")


@query
def request_counts(spark, d):
    return M.request_counts(views.accesses(spark, d))


@query
def request_latency(spark, d):
    return rounded(M.request_latency(views.accesses(spark, d)), "total")


@query
def scrape_series(spark, d):
    return M.scrape_series(views.scrapes(spark, d))


@query
def scrape_sums(spark, d):
    return M.sample_sum(M.sample_values(views.scrapes(spark, d)), "pulse_ingest_events_total", 'outcome="accepted"', ["t"])


@query
def counter_deltas(spark, d):
    return M.counter_deltas(pin(M.scrape_long(views.scrapes(spark, d))))


@query
def metrics_as_of(spark, d):
    """The last event known at moments up to six minutes before each event."""
    events = views.table(spark, d, "events")
    series = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("sample"))
    asked = events.select((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("event_id") % 7 * 60_000_000).alias("asked"))
    return M.metrics_as_of(asked, series)


# --- rebase, exports, frames ------------------------------------------------
@query
def rebase_latest(spark, d):
    rows = views.imported(spark, d).select("row_no", "event_time")
    return B.rebase_latest(rows, datetime(2025, 6, 1, tzinfo=timezone.utc))


@query
def rebase_first(spark, d):
    rows = views.readings(spark, d).select(F.col("n").alias("row_no"), format_nano(F.col("event_time")).alias("event_time"))
    return B.rebase_first(rows, datetime(2025, 6, 1, tzinfo=timezone.utc))


@query
def export_events_csv_rows(spark, d):
    return exports.csv_rows(views.readings(spark, d), BROWSE)


@query
def export_alerts_csv_rows(spark, d):
    return exports.csv_rows(A.evaluate_alerts(views.readings(spark, d)), BROWSE, "alerts")


@query
def export_ndjson_rows(spark, d):
    return exports.ndjson_rows(views.readings(spark, d), BROWSE)


@query
def export_json_pages(spark, d):
    """Page number, objects and both ends of each exported array."""
    p = exports.json_pages(views.readings(spark, d), BROWSE)
    items = F.from_json("value", "array<struct<event_id: string>>")
    return p.select(
        "page", F.size(items).cast("bigint").alias("n"), F.element_at(items, 1)["event_id"].alias("first_id"), F.element_at(items, -1)["event_id"].alias("last_id")
    )


@query
def live_frames(spark, d):
    r = views.readings(spark, d)
    return P.live_frames(r, A.evaluate_alerts(r))


# --- import of files --------------------------------------------------------
def _recording(spark, d):
    """The dirty records under everyday column names, in file order, with a column the schema does not know.

    Unreadable records are rows without values.
    """
    rows = pin(views.imported(spark, d))  # Written, since putting rows in order draws a sample and reads them again.
    lost = F.col("device_id").isNull()
    return rows.orderBy("row_no").select(
        F.col("event_time").alias("Timestamp"), F.col("device_id").alias("Machine"),
        F.when(~lost, F.coalesce(F.col("temperature_c").cast("string"), F.lit("hot"))).alias("Temp"), F.col("vibration_mm_s").alias("Vibration"),
        F.when(~lost, F.concat(F.lit('plant "'), F.coalesce("site_id", F.lit("?")), F.lit('",\nline '), F.col("sequence").cast("string"))).alias("Operator"),
    )


def _csv_recording(spark, d):
    path = folder(spark, "recording")
    _recording(spark, d).write.options(header=True, escape='"').csv(path)
    return path


@query
def import_csv_rows(spark, d):
    """Written as CSV, read back by the importer: row numbers, derived ids, typed cells and reasons."""
    done = mapping.import_file(spark, _csv_recording(spark, d))
    checked = done.checked(instant("2025-01-01T00:00:00Z"))
    return checked.select("row_no", "event_id", "device_id", "temperature_c", "vibration_mm_s", "reason")


@query
def csv_records(spark, d):
    """Cells with quotes, commas and line breaks, read back in splits."""
    return readers.read_csv(spark, _csv_recording(spark, d)).select("row_no", F.col("Machine").alias("machine"), F.col("Operator").alias("operator"))


def _json_texts(spark, d):
    """The recording as JSON objects, numbers written as such."""
    rows = _recording(spark, d)
    number = F.regexp_replace(F.to_json(F.struct(*rows.columns)), r'"Temp":"([0-9.]+)"', '"Temp":$1')
    return rows.select(number.alias("value"))


@query
def import_ndjson_summary(spark, d):
    """Written as NDJSON, read back by the importer: the summary row."""
    path = folder(spark, "recording")
    _json_texts(spark, d).write.text(path)
    done = mapping.import_file(spark, path)
    summary = mapping.dataset_summary(done, done.checked(instant("2025-01-01T00:00:00Z")))
    return summary.withColumns({c: F.array_join(c, ",") for c in ("columns", "mapped", "ignored", "derived")})


@query
def import_json_array(spark, d):
    """Written as files with an array each, read back by the importer in splits."""
    path = folder(spark, "recording")
    rows = global_rank(_json_texts(spark, d).withColumn("at", F.monotonically_increasing_id()), ["at"], "n")
    page = F.lpad(F.floor((F.col("n") - 1) / 5000).cast("string"), 9, "0")
    ends = F.max("n").over(Window.partitionBy("page"))
    begin, end = F.when((F.col("n") - 1) % 5000 == 0, "[").otherwise(""), F.when(F.col("n") == F.col("last"), "]").otherwise(",")
    pages = rows.withColumn("page", page).withColumn("last", ends).repartition("page").sortWithinPartitions("page", "n")
    pages.select("page", F.concat(begin, F.col("value"), end).alias("value")).write.partitionBy("page").text(path)
    done = mapping.import_file(spark, path)
    checked = done.checked(instant("2025-01-01T00:00:00Z"))
    return checked.select("row_no", "event_id", "device_id", "temperature_c", "vibration_mm_s", "reason")


# --- streaming --------------------------------------------------------------
def _stream(spark, d, history=None):
    """The dirty records as NDJSON files, run through the streaming job until everything there is processed."""
    base = folder(spark, "stream")
    rows = views.dirty_json(spark, d)
    lines = F.to_json(F.struct("batch_id", "idx", format_nano(F.col("received_at")).alias("received_at"), "raw"))
    rows.select(lines.alias("value")).write.text(f"{base}/in")
    place = jobs.Tables(base)
    settings = None
    if history is not None:
        settings = f"{base}/settings"
        history.write.parquet(settings)
    jobs.run_ingest(spark, f"{base}/in", place, max_files=None, thresholds_path=settings)
    return place


@query
def stream_ingest_stored(spark, d):
    stored = spark.read.parquet(_stream(spark, d).events)
    return stored.select("event_id", "device_id", "sequence", "temperature_c", "batch_id", "idx")


@query
def stream_alerts(spark, d):
    return spark.read.parquet(_stream(spark, d).alerts).select("alert_id", "rule", "observed")


@query
def stream_thresholds(spark, d):
    """Alerts of the stream when the thresholds change from day to day: each reading meets those that held at its arrival."""
    place = _stream(spark, d, views.threshold_history(spark, d))
    return spark.read.parquet(place.alerts).select("alert_id", "threshold", "observed")


@query
def stream_frames(spark, d):
    """The live messages that the stream has written."""
    return spark.read.parquet(_stream(spark, d).frames).select("type", "device_id", "payload")


@query
def stream_metrics(spark, d):
    """Counters of all micro-batches."""
    counts = spark.read.parquet(_stream(spark, d).metrics)
    return counts.groupBy("metric", "label").agg(F.sum("n").alias("n"))


@query
def stream_bounded_dedup(spark, d):
    """Accepted readings, each event id once, by a stream whose state is bounded; all arrive within its time."""
    path = folder(spark, "bounded")
    V.accepted(views.checked(spark, d)).select("event_time", "event_id").write.parquet(f"{path}/in")
    stream = jobs.dedup_stateful(spark.readStream.schema("event_time timestamp, event_id string").parquet(f"{path}/in"), "60 days")
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id")


@query
def stream_live_latest(spark, d):
    place = _stream(spark, d)
    return jobs.live_latest(spark, place).select("device_id", "event_id", "temperature_c")


@query
def stream_per_second(spark, d):
    """Accepted readings per event-time second, counted by a stateful stream."""
    path = folder(spark, "seconds")
    V.accepted(views.checked(spark, d)).select("event_time", "event_id").write.parquet(f"{path}/in")
    counts = jobs.run_per_second(spark, f"{path}/in", "event_time timestamp, event_id string", path)
    return counts.select(format_nano(F.col("second")).alias("second"), "n")


# --- tables on disk, names and failures --------------------------------------
@query
def lenient_lines(spark, d):
    """Every record as a line of a file: how many a lenient reading keeps, and how many it skips."""
    path = folder(spark, "lines")
    views.dirty_json(spark, d).select(F.col("raw").alias("value")).write.text(path)
    kept = readers.read_ndjson(spark, path).agg(F.count("*"))
    return readers.unreadable_lines(spark, path).select("unreadable_lines", kept.scalar().alias("readable_lines"))


@query
def stored_day(spark, d):
    """Rows written by event date, of which one date is read back from its folder."""
    path = folder(spark, "store")
    Q.write_rows(views.readings(spark, d), path)
    day = spark.read.parquet(path).where(F.col(Q.PARTITION) == F.lit("2024-01-10").cast("date"))
    return day.groupBy("site_id").agg(F.count("*").alias("n"), F.max("temperature_c").alias("max_temperature_c"))


@query
def cleared_rows(spark, d):
    """Both tables written and emptied: what was deleted, and what is left."""
    events, alerts = folder(spark, "events"), folder(spark, "alerts")
    r = views.readings(spark, d)
    r.write.parquet(events)
    A.evaluate_alerts(r).write.parquet(alerts)
    deleted = Q.clear_data(spark, events, alerts, "DELETE")
    return deleted.select("*", spark.read.parquet(events).agg(F.count("*")).scalar().alias("left"))


@query
def failure_stages(spark, d):
    """Failures of a log, per stage: each event failed where its type says, or not at all."""
    persist, alert, shutdown = S.FAILURE_STAGES
    kind = F.col("event_type")
    stage = F.when(kind == "error", persist).when(kind == "signup", alert).when((kind == "view") & (F.col("event_id") > 900), shutdown)
    return M.failure_stages(views.table(spark, d, "events").select(stage.alias("stage")))


@query
def file_names(spark, d):
    """Short names of recordings, and their headers without values."""
    e = views.table(spark, d, "events")
    path = F.concat(F.lit("C:\\data\\"), "event_type", F.lit("/run-"), (F.col("event_id") % 50).cast("string"), F.lit(".csv"))
    hidden = F.map_entries(hide_header_values(F.create_map(F.lit("Authorization"), F.col("props"))))
    shown = F.array_join(F.transform(hidden, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), ",")
    return e.groupBy(base_name(path).alias("name"), shown.alias("header")).agg(F.count("*").alias("n"))
