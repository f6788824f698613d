"""Delivery-log analytics (L1-L17): the input is a log with one row per delivery attempt and a table of runs.

`will_retry` marks an attempt that was followed by another, so the last word on a batch is the attempt without it
and every total is one conditional sum per run; nothing is grouped per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.numbers import fixed_text, tenth_ms, third_decimal_ms
from plantpulse.functions.text import clean_excerpt, display_address, plain_number, table_cell
from plantpulse.functions.times import format_ms
from plantpulse.operators.ordered import InOrder
from plantpulse.operators.ranks import select_ranks

FINISH_ORDER = ["finished_at", "batch_no", "attempt_no"]
#: Seconds of a silence that one array lists.
SILENCE = 3600

# Standard HTTP status texts.
STATUS_TEXT = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing", 103: "Early Hints",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information", 204: "No Content",
    205: "Reset Content", 206: "Partial Content", 207: "Multi-Status", 208: "Already Reported", 226: "IM Used",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified",
    305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found",
    405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout",
    409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed",
    413: "Request Entity Too Large", 414: "Request URI Too Long", 415: "Unsupported Media Type",
    416: "Requested Range Not Satisfiable", 417: "Expectation Failed", 418: "I'm a teapot",
    421: "Misdirected Request", 422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency",
    425: "Too Early", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable",
    504: "Gateway Timeout", 505: "HTTP Version Not Supported", 506: "Variant Also Negotiates",
    507: "Insufficient Storage", 508: "Loop Detected", 510: "Not Extended", 511: "Network Authentication Required",
}


def classify_attempt() -> Column:
    """ok, throttled or error (L1)."""
    success = F.when(F.col("external"), F.col("status").between(200, 299)).otherwise(F.col("status") == 202)
    return (
        F.when(F.col("status").isNull(), F.lit("error"))
        .when(success, F.lit("ok"))
        .when(F.col("status").isin(429, 503), F.lit("throttled"))
        .otherwise(F.lit("error"))
    )


def record_outcomes(attempts: DataFrame) -> DataFrame:
    """What became of the records of each attempt (L2); all zero for an attempt that is retried."""
    ack = lambda c: F.when(F.col("is_ack"), F.coalesce(c, F.lit(0))).otherwise(0)
    ack_accepted, ack_rejected = ack("ack_accepted"), ack("ack_rejected")
    kind, n, final = F.col("kind"), F.col("n_records"), ~F.col("will_retry")
    adds_up = F.col("is_ack") & (ack_accepted + ack_rejected == n)
    ok, refused = kind == "ok", (kind == "throttled") & final
    own_words = ok & (~F.col("external") | adds_up)
    counted = own_words | refused
    return attempts.withColumn("kind", classify_attempt()).select(
        *attempts.columns,
        "kind",
        F.when(own_words, ack_accepted).when(ok, n).otherwise(0).alias("accepted"),
        F.when(counted, ack_rejected).otherwise(0).alias("rejected"),
        F.when(counted & F.col("is_ack"), F.col("ack_rejection_counts")).alias("rejection_counts"),
        F.when(refused, F.greatest(F.lit(0), n - ack_rejected)).otherwise(0).alias("gave_up"),
        F.when(kind == "error", n).otherwise(0).alias("errored"),
    )


def _sums() -> list[Column]:
    """Counts of rows of `record_outcomes`; they add up over parts of a run."""
    final = ~F.col("will_retry")
    return [
        F.count_if(final).alias("batches_done"),
        F.sum(F.when(final, F.col("n_records")).otherwise(0)).alias("records_done"),
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"),
        F.count_if(F.col("status") == 429).alias("throttled"),
        F.count_if("will_retry").alias("retries"),
        F.sum("gave_up").alias("gave_up_records"),
        F.count_if(F.col("kind") == "error").alias("request_errors"),
        F.sum("errored").alias("errored_records"),
    ]


def run_totals(attempts: DataFrame, runs: DataFrame, basis: str = "done") -> DataFrame:
    """Totals per run (L3). `basis` is what throughput counts: records `done` or `attempted` (planned)."""
    return _with_runs(record_outcomes(attempts).groupBy("run_id").agg(*_sums()), runs, basis)


def _with_runs(totals: DataFrame, runs: DataFrame, basis: str = "done", *kept: str) -> DataFrame:
    names = [c for c in totals.columns if c not in ("run_id", *kept)]
    joined = runs.select("run_id", "planned", "batches", "elapsed_s").join(totals, "run_id", "left")
    filled = joined.select(
        "run_id", "planned", "batches", "elapsed_s", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names], *kept
    )
    basis_col = {"done": "records_done", "attempted": "planned"}[basis]
    rate = F.when(F.col("elapsed_s") > 0, F.col(basis_col) / F.col("elapsed_s")).otherwise(0.0)
    return filled.withColumn("throughput_per_s", rate)


def rejection_totals(attempts: DataFrame) -> DataFrame:
    """Rejected records per run and reason, from the acknowledgements."""
    return (
        record_outcomes(attempts)
        .select("run_id", F.explode("rejection_counts").alias("reason", "n"))
        .groupBy("run_id", "reason")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def status_counts(attempts: DataFrame) -> DataFrame:
    """Answers per run and status (L4); an attempt without an answer has none."""
    return (
        attempts.where(F.col("status").isNotNull())
        .groupBy("run_id", "status")
        .agg(F.count("*").alias("n"))
    )


def _latency_us() -> Column:
    return F.unix_micros("finished_at") - F.unix_micros("started_at")


def _ranked(latencies: DataFrame, by: list[str]) -> DataFrame:
    """`_us`, how many rows have it (`_n`), how many have it or less (`_upto`) and the rows of the group (`_all`).

    Equal latencies are counted before anything is ordered, so a group of any size is as large as its number of different
    microseconds, and no list of it is ever built.
    """
    counts = latencies.groupBy(*by, F.col("latency_us").alias("_us")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = F.sum("_n").over(group.orderBy("_us").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(group))


def latency_summary(attempts: DataFrame) -> DataFrame:
    """Nearest-rank percentiles, maximum and mean per run in ms (L5), over all attempts of the run."""
    latencies = attempts.select("run_id", _latency_us().alias("value"), F.lit(1).cast("bigint").alias("n"))
    totals = latencies.groupBy("run_id").agg(F.sum("n").alias("count"), F.max("value").alias("_max"), F.sum("value").alias("_sum"))
    marks = F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(p / 100) * F.col("count"))).cast("bigint").alias("rank")) for p in (50, 95, 99)])
    wanted = totals.select("run_id", F.inline(marks))
    found = select_ranks(latencies, wanted.select("run_id", "rank").distinct(), ["run_id"]).join(wanted, ["run_id", "rank"])
    at = lambda p: third_decimal_ms(F.max(F.when(F.col("p") == p, F.col("value"))) / 1e6).alias(f"p{p}_ms")
    return totals.join(found.groupBy("run_id").agg(*map(at, (50, 95, 99))), "run_id").select(
        "run_id",
        "count",
        *[f"p{p}_ms" for p in (50, 95, 99)],
        third_decimal_ms(F.col("_max") / 1e6).alias("max_ms"),
        third_decimal_ms(F.col("_sum") / F.col("count") / 1e6).alias("mean_ms"),
    )


def _error_sample() -> Column:
    """What is shown of a failed attempt, in words that are safe to show."""
    texts = F.create_map(*[F.lit(p) for pair in STATUS_TEXT.items() for p in pair])
    answered = F.concat(
        F.lit("the service answered "), F.col("status").cast("string"), F.lit(" "),
        F.coalesce(F.try_element_at(texts, F.col("status")), F.lit("")),
    )
    transport = F.when(F.lower("error").contains("deadline exceeded"), F.lit("no answer before the timeout")).otherwise(
        clean_excerpt(F.col("error"), 200)
    )
    return F.struct(
        (F.col("batch_no") + 1).alias("batch"),
        "status",
        F.when(F.col("status").isNull(), transport).otherwise(answered).alias("message"),
        F.when(F.col("status").isNotNull(), clean_excerpt(F.coalesce("body", F.lit("")), 300)).alias("body"),
    )


def first_error(attempts: DataFrame) -> DataFrame:
    """Earliest failed attempt per run."""
    failed = attempts.where(classify_attempt() == "error")
    first = failed.groupBy("run_id").agg(F.min_by(F.struct("batch_no", "status", "error", "body"), F.struct(*FINISH_ORDER)).alias("e"))
    return first.select("run_id", "e.*").select("run_id", _error_sample().alias("e")).select("run_id", "e.*")


def _in_seconds(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    starts = runs.select("run_id", F.col("started_at").alias("_run_start"))
    second = F.floor((F.unix_micros("finished_at") - F.unix_micros("_run_start")) / 1_000_000)
    return attempts.join(starts, "run_id").withColumn("t", F.greatest(F.lit(0), second).cast("int"))


def timeline(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run and second, silent seconds included (L7), with the percentiles of L8 over all its answers."""
    timed = _in_seconds(attempts, runs).withColumn("kind", classify_attempt())
    points = timed.groupBy("run_id", "t").agg(
        F.count("*").alias("requests"),
        F.sum("n_records").alias("sent"),
        F.sum(F.when(F.col("kind") == "ok", F.col("n_records")).otherwise(0)).alias("records"),
        F.count_if(F.col("kind") == "throttled").alias("throttled"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    ranked = _ranked(timed.select("run_id", "t", _latency_us().alias("latency_us")), ["run_id", "t"])
    above = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_us"))) / 1e6
    marks = ranked.groupBy("run_id", "t").agg(
        tenth_ms(above(F.floor((F.col("_all") - 1) / 2))).alias("p50_ms"),
        tenth_ms(above(F.floor((F.col("_all") - 1) * F.lit(0.95)))).alias("p95_ms"),
    )
    # Silent seconds: each point is repeated up to the next one of its run.
    by_run = Window.partitionBy("run_id").orderBy("t")
    start = F.when(F.lag("t").over(by_run).isNull(), F.lit(0)).otherwise(F.col("t"))
    end = F.coalesce(F.lead("t").over(by_run) - 1, F.col("t"))
    counts = ["requests", "sent", "records", "throttled", "errors"]
    values = [*counts, "p50_ms", "p95_ms"]
    # First into hours and then into their seconds: a silence of years is no long array either.
    spans = points.join(marks, ["run_id", "t"], "left").select("*", start.alias("_start"), end.alias("_end"))
    hours = spans.select("*", F.explode(F.sequence(*[F.floor(F.col(c) / SILENCE).cast("int") for c in ("_start", "_end")])).alias("_hour"))
    first = F.col("_hour") * SILENCE
    seconds = F.sequence(F.greatest("_start", first), F.least("_end", first + SILENCE - 1))
    dense = hours.select("run_id", F.col("t").alias("_t"), *values, F.explode(seconds).alias("t"))
    here = F.col("t") == F.col("_t")
    return dense.select(
        "run_id",
        "t",
        *[F.when(here, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in counts],
        *[F.when(here, F.col(c)).otherwise(0.0).alias(c) for c in ("p50_ms", "p95_ms")],
    )


def timeline_summary(points: DataFrame, edge: int = 3) -> DataFrame:
    """Best second, first trouble and the slowest requests at both ends."""
    first = lambda when: F.min_by(
        F.when(when, F.struct("t", "sent")), F.when(when, F.col("t"))
    )
    ends = Window.partitionBy("run_id").orderBy
    busy = (
        points.where(F.col("requests") > 0)
        .withColumn("_a", F.row_number().over(ends(F.col("t").asc())))
        .withColumn("_z", F.row_number().over(ends(F.col("t").desc())))
        .groupBy("run_id")
        .agg(
            F.max(F.when(F.col("_a") <= edge, F.col("p95_ms"))).alias("p95_first_ms"),
            F.max(F.when(F.col("_z") <= edge, F.col("p95_ms"))).alias("p95_last_ms"),
        )
    )
    totals = points.groupBy("run_id").agg(
        F.max("sent").alias("peak_sent_per_s"),
        F.max("records").alias("peak_accepted_per_s"),
        first(F.col("throttled") > 0).alias("_t"),
        first(F.col("errors") > 0).alias("_e"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return totals.join(busy, "run_id", "left").select(
        "run_id",
        "peak_sent_per_s",
        "peak_accepted_per_s",
        F.col("_t.t").alias("first_throttled_at_s"),
        F.col("_t.sent").alias("sent_per_s_at_first_throttle"),
        F.col("_e.t").alias("first_error_at_s"),
        F.col("_e.sent").alias("sent_per_s_at_first_error"),
        zero("p95_first_ms"),
        zero("p95_last_ms"),
    )


def thin_timeline(points: DataFrame, most: int = S.MAX_REPORT_SECONDS) -> DataFrame:
    """Every k-th second, so that a run shows at most `most`."""
    step = points.groupBy("run_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int").alias("step"))
    return points.join(step, "run_id").where(F.col("t") % F.col("step") == 0)


def run_records(attempts: DataFrame, runs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One history row per run (L11): totals, answers and first failure come from one pass over the attempts."""
    points = timeline(attempts, runs) if points is None else points
    first = F.when(F.col("kind") == "error", F.struct(*FINISH_ORDER, "status", "error", "body"))
    by_status = record_outcomes(attempts).groupBy("run_id", "status").agg(*_sums(), F.count("*").alias("_n"), F.min(first).alias("_first"))
    entry = F.when(F.col("status").isNotNull(), F.struct("status", F.col("_n").alias("n")))
    names = [c for c in by_status.columns if c not in ("run_id", "status", "_n", "_first")]
    per_run = by_status.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in names], F.min("_first").alias("_first"), F.array_sort(F.collect_list(entry)).alias("_answers")
    )
    answers = F.when(F.size("_answers") > 0, F.map_from_entries("_answers"))
    failed = per_run.select("run_id", *names, answers.alias("status_counts"), F.col("_first.*"))
    error = F.when(F.col("batch_no").isNotNull(), _error_sample()).alias("first_error")
    totals = _with_runs(failed.select("run_id", *names, "status_counts", error), runs, "done", "status_counts", "first_error")
    return (
        runs.select("run_id", "state", "source", display_address(F.col("target")).alias("target"), "external", "started_at", "config")
        .join(totals, "run_id")
        .join(latency_summary(attempts), "run_id", "left")
        .join(timeline_summary(points), "run_id", "left")
        .withColumn("id", F.date_format("started_at", "yyyyMMdd'T'HHmmss.SSS'Z'"))
    )


# Rows of a comparison; measures with their unit and the better direction, texts without.
COMPARED = [
    ("Started", None, "", ""),
    ("Sent to", None, "", ""),
    ("Data", None, "", ""),
    ("Pace", None, "", ""),
    ("Records sent", "records_done", "", ""),
    ("Accepted", "accepted", "", "higher"),
    ("Peak sent per second", "peak_sent_per_s", "", ""),
    ("Peak accepted per second", "peak_accepted_per_s", "", "higher"),
    ("Requests told to slow down (429)", "throttled", "", "lower"),
    ("First 429", None, "", ""),
    ("Request errors", "request_errors", "", "lower"),
    ("Latency p95", "p95_ms", " ms", "lower"),
    ("Latency p99", "p99_ms", " ms", "lower"),
    ("Latency max", "max_ms", " ms", "lower"),
    ("Took", "elapsed_s", " s", ""),
]


def _compared(records: DataFrame) -> DataFrame:
    """One row per run and line of the comparison, with its number and what is shown."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("–")).otherwise(F.col(c))
    texts = {
        "Started": F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), "Sent to": given("target"), "Data": given("source"), "Pace": short_pace_text(),
        "First 429": first_throttle_text(),
    }

    def entry(no: int, label: str, column: str | None, unit: str, better: str) -> Column:
        value = F.lit(None).cast("double") if column is None else F.col(column).cast("double")
        value = F.round(value, 1) if column == "elapsed_s" else value
        text = texts.get(label, F.lit(None).cast("string"))
        parts = {"no": F.lit(no), "measure": F.lit(label), "value": value, "text": text, "unit": F.lit(unit), "better": F.lit(better)}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    long = records.select("run_id", F.inline(F.array(*[entry(i, *row) for i, row in enumerate(COMPARED, 1)])))
    return long.withColumn("shown", F.coalesce("text", F.concat(_number_text(F.col("value")), F.col("unit")))).drop("text")


def run_pairs(runs: DataFrame) -> DataFrame:
    """Each run with the one started before it."""
    slim = runs.select("started_at", F.col("run_id").alias("run_b"))
    return (
        InOrder(slim, [], ["started_at", "run_b"])
        .lag(F.col("run_b"), "run_a")
        .where(F.col("run_a").isNotNull())
        .select("run_a", "run_b")
    )


def compare_runs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The older run A and the newer run B line by line, measures with the change and its direction."""
    long = _compared(records)
    a = long.select(F.col("run_id").alias("run_a"), "no", "measure", F.col("value").alias("a"), F.col("shown").alias("shown_a"), "unit", "better")
    b = long.select(F.col("run_id").alias("run_b"), "no", F.col("value").alias("b"), F.col("shown").alias("shown_b"))
    d = F.col("b") - F.col("a")
    sign = F.when(d > 0, F.lit("+")).otherwise(F.lit("−"))
    diff = F.round(F.abs(d), 2)
    percent = F.when(F.col("a") != 0, F.round(F.abs(100 * d / F.col("a")), 0).cast("bigint"))
    shown = F.concat(
        sign, _number_text(diff), F.col("unit"),
        F.coalesce(F.concat(F.lit(" ("), sign, percent.cast("string"), F.lit("%)")), F.lit("")),
    )
    good = (F.col("b") > F.col("a")) == (F.col("better") == "higher")
    return (
        pairs.join(a, "run_a")
        .join(b, ["run_b", "no"])
        .select(
            "run_a", "run_b", "no", "measure", "a", "b", "shown_a", "shown_b",
            F.round(d, 2).alias("difference"),
            percent.alias("percent"),
            F.when(d == 0, F.lit("same")).otherwise(shown).alias("change"),
            F.when((F.col("better") == "") | (d == 0), F.lit(""))
            .when(good, F.lit("better"))
            .otherwise(F.lit("worse"))
            .alias("verdict"),
        )
    )


def first_throttle_text() -> Column:
    """When and at what rate a run was first told to slow down."""
    return F.when(F.col("first_throttled_at_s").isNull(), F.lit("none")).otherwise(
        F.concat(
            F.lit("at "), F.col("first_throttled_at_s").cast("string"), F.lit(" s ("),
            F.col("sent_per_s_at_first_throttle").cast("string"), F.lit("/s)"),
        )
    )


def _number_text(value: Column) -> Column:
    """`plain_number` inside a lambda: its long expression is not copied into the code of every line."""
    return F.transform(F.array(value.cast("double")), plain_number)[0]


def _setting(name: str) -> Column:
    return F.coalesce(F.get_json_object("config", f"$.{name}").try_cast("double"), F.lit(0.0))


def pace_text() -> Column:
    """How fast the run was to send."""
    g = lambda name: _number_text(_setting(name))
    pace = (
        F.when(
            _setting("ramp_to_per_s") > 0,
            F.concat(F.lit("ramp from "), g("rate_per_s"), F.lit(" to "), g("ramp_to_per_s"), F.lit(" records/s over "), g("ramp_s"), F.lit(" s")),
        )
        .when(_setting("rate_per_s") > 0, F.concat(g("rate_per_s"), F.lit(" records/s")))
        .otherwise("as fast as possible")
    )
    recorded = F.concat(F.lit(", following the recorded time at "), g("speed"), F.lit(" x"))
    return F.when(_setting("speed") > 0, F.concat(pace, recorded)).otherwise(pace)


def short_pace_text() -> Column:
    """How fast the run was to send, as a comparison shows it."""
    g = lambda name: _number_text(_setting(name))
    plain = F.when(_setting("rate_per_s") > 0, F.concat(g("rate_per_s"), F.lit("/s"))).otherwise("as fast as possible")
    ramp = F.concat(F.lit("ramp "), g("rate_per_s"), F.lit("→"), g("ramp_to_per_s"), F.lit("/s over "), g("ramp_s"), F.lit(" s"))
    pace = F.when(_setting("ramp_to_per_s") > 0, ramp).otherwise(plain)
    recorded = F.when(_setting("speed") > 0, F.concat(F.lit(", "), g("speed"), F.lit("× recorded"))).otherwise("")
    many = F.when(_setting("concurrency") == 1, "").otherwise("s")
    text = F.concat(pace, recorded, F.lit(", batches of "), g("batch_size"), F.lit(", "), g("concurrency"), F.lit(" connection"), many)
    return F.when(F.col("config").isNull(), F.lit("–")).otherwise(text)


# Lines of the report that hold no number.
SECONDS_HEAD = ["| Second | Sent | Accepted | Requests | 429 | Errors | p95 ms |", "|---:|---:|---:|---:|---:|---:|---:|"]
FOOTER = (
    "Addresses are shown without their query string and header values are never included. Readings sent to your own service are not stored. "
    "Rows are counted after a file's header."
)


def report_lines(
    records: DataFrame, points: DataFrame, checks: DataFrame | None = None, datasets: DataFrame | None = None, rejections: DataFrame | None = None
) -> DataFrame:
    """The report of each run as ordered text lines (L13), sections in the order head, setup, results, over_time,
    seconds_head, seconds, seconds_note, data_head, data_check, rejections, footer.

    Of the data a run has sent, `datasets` (run_id, name, rows, devices) adds the heading, `checks` (run_id, line_no, level,
    text) the findings, and `rejections` (run_id, reason, label, n, row, detail) the groups, with a row per example.
    """
    s = lambda c: F.col(c).cast("string")
    g = lambda c: _number_text(F.col(c))

    def text(*parts: "Column | str") -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    faults = _setting("malformed_rate") + _setting("duplicate_rate") + _setting("late_rate") > 0
    percent = lambda name: _number_text(F.round(100 * _setting(name), 6))
    statuses = F.array_join(
        F.transform(
            F.map_entries("status_counts"),
            lambda e: F.concat(e["key"].cast("string"), F.lit(" x "), e["value"].cast("string")),
        ),
        ", ",
    )
    problem = F.concat(
        F.col("first_error.message"),
        F.when(F.coalesce(F.col("first_error.body"), F.lit("")) != "", F.concat(F.lit(" - "), F.col("first_error.body"))).otherwise(""),
    )
    sections = [
        ("head", [
            F.lit("# Replay report"),
            text("Run started ", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), ", state: **", F.col("state"),
                 "**, took ", fixed_text(F.col("elapsed_s"), 1), " s."),
        ]),
        ("setup", [
            text("| Sent to | ", table_cell(F.col("target")), " |"),
            text("| Data | ", table_cell(F.col("source")), " |"),
            text("| Pace | ", pace_text(), " |"),
            text("| Batch size / connections | ", _number_text(_setting("batch_size")), " / ", _number_text(_setting("concurrency")), " |"),
            text("| Retries on 429 | ", _number_text(_setting("retries")), " |"),
            F.when(
                faults | (_setting("burst_every") > 0),
                text("| Faults added | malformed ", percent("malformed_rate"), "%, duplicated ", percent("duplicate_rate"),
                     "%, late ", percent("late_rate"), "%, burst every ", _number_text(_setting("burst_every")),
                     " batches of ", _number_text(_setting("burst_size")), " |"),
            ),
        ]),
        ("results", [
            text("| Records sent | ", s("records_done"), " of ", s("planned"), " planned |"),
            text("| Accepted | ", s("accepted"), " |"),
            text("| Rejected as invalid | ", s("rejected"), " |"),
            text("| Told to slow down (429) | ", s("throttled"), " times, ", s("retries"), " retries, ", s("gave_up_records"), " records given up |"),
            text("| Request errors | ", s("request_errors"), " (", s("errored_records"), " records) |"),
            text("| Average throughput | ", fixed_text(F.col("throughput_per_s"), 0), " records/s |"),
            F.when(
                F.col("count").isNotNull(),
                text("| Request latency | p50 ", g("p50_ms"), " ms, p95 ", g("p95_ms"), " ms, p99 ", g("p99_ms"), " ms, max ", g("max_ms"), " ms |"),
            ),
            F.when(F.size("status_counts") > 0, text("| Responses | ", statuses, " |")),
            F.when(
                F.col("first_error").isNotNull(),
                text("| First problem | request ", F.col("first_error.batch").cast("string"), ": ", table_cell(problem), " |"),
            ),
        ]),
        ("over_time", [
            text("- Sent up to ", s("peak_sent_per_s"), " records a second; the service accepted up to ", s("peak_accepted_per_s"), "."),
            F.when(
                F.col("first_throttled_at_s").isNotNull(),
                text("- First told to slow down (429) at ", s("first_throttled_at_s"), " s, when about ",
                     s("sent_per_s_at_first_throttle"), " records a second were being sent."),
            ),
            F.when(
                F.col("first_error_at_s").isNotNull(),
                text("- First error at ", s("first_error_at_s"), " s, at about ", s("sent_per_s_at_first_error"), " records a second."),
            ),
            text("- The slowest 5% of requests took ", g("p95_first_ms"), " ms at the start and ", g("p95_last_ms"), " ms at the end."),
        ]),
    ]
    fixed = F.array(
        *[
            F.struct(F.lit(name).alias("section"), F.lit(i).alias("line_no"), line.alias("text"))
            for name, lines in sections
            for i, line in enumerate(lines, 1)
        ]
    )
    out = records.select("run_id", F.inline(fixed)).where(F.col("text").isNotNull())
    cells = [s(c) for c in ("t", "sent", "records", "requests", "throttled", "errors")]
    seconds = thin_timeline(points).select(
        "run_id",
        F.lit("seconds").alias("section"),
        (F.col("t") + 1).alias("line_no"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells, g("p95_ms")), F.lit(" |")).alias("text"),
    )
    out = out.unionByName(seconds)

    def lines(df: DataFrame, section: str, *texts: Column) -> DataFrame:
        numbered = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(i).alias("line_no"), t.alias("text")) for i, t in enumerate(texts, 1)])
        return df.select("run_id", F.inline(numbered))

    step = points.groupBy("run_id").agg(F.ceil(F.count("*") / S.MAX_REPORT_SECONDS).alias("step"))
    out = out.unionByName(lines(step, "seconds_head", *map(F.lit, SECONDS_HEAD)))
    out = out.unionByName(lines(step.where("step > 1"), "seconds_note", text("Every ", s("step"), " seconds are shown.")))
    out = out.unionByName(lines(records, "footer", F.lit(FOOTER)))
    if datasets is not None:
        out = out.unionByName(lines(datasets, "data_head", text("## Data check of ", table_cell(F.col("name"))), text(s("rows"), " rows, ", s("devices"), " devices.")))
    if rejections is not None:
        example = F.struct("row", text("row ", s("row"), ": ", table_cell(F.col("detail"))).alias("text"))
        groups = rejections.groupBy("run_id", "reason", "label", "n").agg(F.array_join(F.array_sort(F.collect_list(example))["text"], "; ").alias("examples"))
        order = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "reason"))
        out = out.unionByName(groups.select("run_id", F.lit("rejections").alias("section"), order.alias("line_no"), text("  - ", s("n"), " x ", F.col("label"), " (", F.col("examples"), ")").alias("text")))
    if checks is not None:
        out = out.unionByName(
            checks.select(
                "run_id",
                F.lit("data_check").alias("section"),
                "line_no",
                F.concat(F.lit("- **"), F.upper("level"), F.lit("**: "), table_cell(F.col("text"))).alias("text"),
            )
        )
    return out


def run_documents(records: DataFrame, points: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """The report of each run as one JSON object: the run, its timeline and the data check.

    A document holds every second of its run; for runs of many days take the rows of `timeline` instead.
    """

    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        fields = [c for c in df.columns if c != "run_id"]
        entry = F.struct(order, *[c for c in fields if c != order])
        return df.groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias(name))

    run = F.struct(*records.columns)
    out = records.select("run_id", run.alias("run")).join(listed(points, "timeline", "t"), "run_id", "left")
    parts = ["run", "timeline"]
    if checks is not None:
        out = out.join(listed(checks, "data_check", "line_no"), "run_id", "left")
        parts.append("data_check")
    return out.select("run_id", F.to_json(F.struct(*parts)).alias("document"))


def run_outcome(totals: DataFrame, runs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The closing line of each run (L17). `stored` has (run_id, stored): rows the run added to the store."""
    joined = runs.select("run_id", "state", "external", display_address(F.col("target")).alias("target")).join(totals, "run_id")
    joined = joined.join(stored, "run_id", "left") if stored is not None else joined.withColumn("stored", F.lit(None).cast("bigint"))
    n = lambda c: F.col(c).cast("string")
    done = F.when(F.col("planned") > 0, F.least(F.lit(100.0), 100.0 * F.col("records_done") / F.col("planned"))).otherwise(0.0)
    already = F.greatest(F.lit(0), F.col("accepted") - F.col("stored"))
    times = F.when(F.col("throttled") == 1, F.lit("1 time")).otherwise(F.concat(n("throttled"), F.lit(" times")))
    gave_up = F.when(F.col("gave_up_records") > 0, F.concat(F.lit(", "), n("gave_up_records"), F.lit(" gave up after retries"))).otherwise("")
    target = F.when(F.coalesce("target", F.lit("")) == "", F.lit("your service")).otherwise(F.col("target"))
    outside = F.concat(
        n("records_done"), F.lit(" sent to "), target, F.lit(", "), n("accepted"), F.lit(" accepted, "),
        n("errored_records"), F.lit(" failed"),
        F.when(F.col("throttled") > 0, F.concat(F.lit(", answered 429 "), times)).otherwise(""),
        gave_up,
    )
    inside = F.concat(
        n("records_done"), F.lit(" sent, "),
        F.when(F.col("stored").isNull(), F.concat(n("accepted"), F.lit(" accepted, "))).otherwise(F.concat(n("stored"), F.lit(" stored, "))),
        n("rejected"), F.lit(" rejected"),
        F.when(already > 0, F.concat(F.lit(" ("), already.cast("string"), F.lit(" already stored)"))).otherwise(""),
        gave_up,
    )
    lead = F.when(F.col("state") == "stopped", F.lit("Stopped early: ")).otherwise("Replay done: ")
    return joined.select(
        "run_id",
        F.round(done, 1).alias("progress_percent"),
        F.when(F.col("external"), F.lit(None).cast("bigint")).otherwise(F.when(already > 0, already)).alias("already_stored"),
        F.concat(lead, F.when(F.col("external"), outside).otherwise(inside)).alias("line"),
    )


def conservation_check(checked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Nothing is lost or invented (L14): per batch, accepted + refused = received and stored + duplicate = accepted.

    `checked` holds every received row with its reason, `outcomes` the accepted ones after the store.
    """
    received = checked.groupBy("batch_id").agg(
        F.count("*").alias("received"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("refused"),
    )
    kept = outcomes.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate"),
    )
    stored = outcomes.where(F.col("outcome") == "stored").select("batch_id", "idx")
    leaked = (
        checked.where(F.col("reason").isNotNull())
        .select("batch_id", "idx")
        .join(stored, ["batch_id", "idx"], "left_semi")
        .groupBy("batch_id")
        .agg(F.count("*").alias("refused_but_stored"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = received.join(kept, "batch_id", "left").join(leaked, "batch_id", "left")
    filled = joined.select(
        "batch_id", "received", "accepted", "refused", zero("stored"), zero("duplicate"), zero("refused_but_stored")
    )
    return filled.withColumn(
        "conserved",
        (F.col("accepted") + F.col("refused") == F.col("received"))
        & (F.col("stored") + F.col("duplicate") == F.col("accepted"))
        & (F.col("refused_but_stored") == 0),
    )
