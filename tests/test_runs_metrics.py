import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.operators import metrics as M
from plantpulse.operators import runs as L

T0 = 1_736_928_000_000_000


def log(spark, attempts):
    """(run, batch, attempt, finish_s, latency_s, n, status, will_retry[, external, ack])"""
    out = []
    for a in attempts:
        run, batch, attempt, finish, latency, n, status, retry = a[:8]
        external = a[8] if len(a) > 8 else False
        ack = a[9] if len(a) > 9 else (n, 0)
        finished = T0 + round(finish * 1e6)
        out.append((run, batch, attempt, finished - round(latency * 1e6), finished, n, status, None if status else "dial tcp: refused\n", "bad\tthing" if status == 500 else None,
                    external, ack is not None, ack[0] if ack and status in (200, 202) else 0, ack[1] if ack else 0, {"missing_field": ack[1]} if ack and ack[1] else None, retry))
    names = [f.name for f in S.ATTEMPT_SCHEMA.fields]
    df = spark.createDataFrame(out, "run_id string, batch_no int, attempt_no int, s bigint, f bigint, n_records int, status int, error string, body string,"
                                    "external boolean, is_ack boolean, ack_accepted int, ack_rejected int, ack_rejection_counts map<string,int>, will_retry boolean")
    return df.withColumn("started_at", F.timestamp_micros("s")).withColumn("finished_at", F.timestamp_micros("f")).select(*names)


def runs(spark, *ids, elapsed=10.0):
    df = spark.createDataFrame([(r, "done", "file.csv", "http://h:1/x?k=1", False, elapsed, 80, 40, "{}") for r in ids],
                               "run_id string, state string, source string, target string, external boolean, elapsed_s double, planned int, batches int, config string")
    return df.withColumn("started_at", F.timestamp_micros(F.lit(T0).cast("bigint")))


def test_throttled_run(spark):
    attempts = log(spark, [("r", i, 0, i * 0.05, 0.01, 2, 202 if i < 30 else 429, False) for i in range(40)])
    t = L.run_totals(attempts, runs(spark, "r")).first()
    assert (t["accepted"], t["throttled"], t["gave_up_records"], t["records_done"], t["batches_done"], t["retries"]) == (60, 10, 20, 80, 40, 0)
    assert t["throughput_per_s"] == 8.0
    points = L.timeline(attempts, runs(spark, "r"))
    total = points.agg(*[F.sum(c).alias(c) for c in ("requests", "records", "throttled")]).first()
    assert tuple(total) == (40, 60, 10)
    s = L.timeline_summary(points).first()
    assert s["first_error_at_s"] is None and s["first_throttled_at_s"] == 1
    assert L.first_error(attempts).count() == 0


def test_failed_run(spark):
    attempts = log(spark, [("r", i, 0, i * 0.5, 0.01, 2, 500, False) for i in range(4)] + [("r", 9, 0, 5.0, 0.01, 2, None, False)])
    s = L.timeline_summary(L.timeline(attempts, runs(spark, "r"))).first()
    assert s["first_throttled_at_s"] is None and s["first_error_at_s"] == 0
    e = L.first_error(attempts).first()
    assert (e["batch"], e["status"], e["message"], e["body"]) == (1, 500, "the service answered 500 Internal Server Error", "bad thing")
    only = L.first_error(attempts.where("status is null")).first()
    assert (only["message"], only["status"], only["body"]) == ("dial tcp: refused", None, None)
    t = L.run_totals(attempts, runs(spark, "r")).first()
    assert (t["request_errors"], t["errored_records"]) == (5, 10)
    assert rows(L.status_counts(attempts), "status", "n") == [(500, 4)]


def test_outcomes_of_records(spark):
    attempts = log(spark, [
        ("r", 0, 0, 1, 0.1, 10, 429, True, False, (0, 2)), ("r", 0, 1, 2, 0.1, 10, 202, False, False, (8, 2)),
        ("r", 1, 0, 1, 0.1, 10, 429, True, False, (0, 3)), ("r", 1, 1, 2, 0.1, 10, 503, False, False, (0, 3)),
        ("x", 0, 0, 1, 0.1, 10, 200, False, True, None), ("x", 1, 0, 1, 0.1, 10, 200, False, True, (7, 3)),
        ("x", 2, 0, 1, 0.1, 10, 200, False, True, (7, 1)), ("r", 2, 0, 1, 0.1, 10, 200, False, False, (9, 1)),
    ])
    got = rows(L.record_outcomes(attempts), "run_id", "batch_no", "attempt_no", "kind", "accepted", "rejected", "gave_up", "errored")
    assert got == sorted([
        ("r", 0, 0, "throttled", 0, 0, 0, 0), ("r", 0, 1, "ok", 8, 2, 0, 0), ("r", 1, 0, "throttled", 0, 0, 0, 0), ("r", 1, 1, "throttled", 0, 3, 7, 0),
        ("x", 0, 0, "ok", 10, 0, 0, 0), ("x", 1, 0, "ok", 7, 3, 0, 0), ("x", 2, 0, "ok", 10, 0, 0, 0), ("r", 2, 0, "error", 0, 0, 0, 10)], key=repr)
    assert rows(L.rejection_totals(attempts), "run_id", "reason", "n") == [("r", "missing_field", 5), ("x", "missing_field", 3)]
    assert rows(M.ingest_outcomes(attempts.where("run_id = 'r'")), "outcome", "n") == [
        ("accepted", 8), ("rejected_invalid", 10), ("rejected_overload", 15), ("rejected_shutdown", 7)]


def test_percentiles(spark):
    attempts = log(spark, [("r", i, 0, 0.5, i / 1000, 1, 202, False) for i in range(1, 101)])
    p = L.latency_summary(attempts).first()
    assert (p["p50_ms"], p["p95_ms"], p["p99_ms"], p["max_ms"], p["mean_ms"], p["count"]) == (50.0, 95.0, 99.0, 100.0, 50.5, 100)
    point = L.timeline(attempts, runs(spark, "r")).first()
    assert (point["p50_ms"], point["p95_ms"]) == (50.0, 95.0)  # by index, not by nearest rank
    four = L.latency_summary(log(spark, [("r", i, 0, i, i / 1000, 1, 202, False) for i in (1, 2, 3, 4)])).first()
    assert (four["p50_ms"], four["max_ms"], four["mean_ms"]) == (2.0, 4.0, 2.5)


def test_all_attempts_of_a_large_run_and_a_busy_second_count(spark):
    """More attempts than any list of them should hold, all of one run and most of one second."""
    n = 210_000
    attempts = spark.range(n).selectExpr(
        "'r' AS run_id", "int(id) AS batch_no", "0 AS attempt_no", "timestamp_micros(bigint(1704067200000000) + id DIV 700 * 1000) AS started_at",
        "timestamp_micros(bigint(1704067200000000) + id DIV 700 * 1000 + id % 700) AS finished_at", "1 AS n_records", "202 AS status",
        "string(null) AS error", "string(null) AS body", "false AS external", "false AS is_ack", "0 AS ack_accepted", "0 AS ack_rejected",
        "map('x', 1) AS ack_rejection_counts", "false AS will_retry")
    p = L.latency_summary(attempts).first()
    assert (p["count"], p["p50_ms"], p["max_ms"], p["mean_ms"]) == (n, 0.349, 0.699, 0.35)
    point = L.timeline(attempts, runs(spark, "r")).first()
    assert (point["t"], point["requests"], point["p50_ms"], point["p95_ms"]) == (0, n, 0.3, 0.7)


def test_a_long_silence_is_no_long_array(spark, monkeypatch):
    """Seconds before the first answer and between answers, over several steps that do not end where the silence does."""
    monkeypatch.setattr(L, "SILENCE", 7)
    attempts = log(spark, [(r, i, 0, t + 0.5, 0.1, 1, 202, False) for r, times in (("a", (3, 17, 18, 48)), ("b", (20, 21, 27, 28))) for i, t in enumerate(times)])
    points = L.timeline(attempts, runs(spark, "a", "b"))
    want = [("a", t, int(t in (3, 17, 18, 48))) for t in range(49)] + [("b", t, int(t in (20, 21, 27, 28))) for t in range(29)]
    assert rows(points, "run_id", "t", "requests") == sorted(want, key=repr)
    assert points.schema["t"].dataType.simpleString() == "int"


def test_dense_seconds_beyond_an_hour(spark):
    attempts = log(spark, [("r", 0, 0, -5, 0.1, 1, 202, False), ("r", 1, 0, 4.2, 0.1, 1, 202, False), ("r", 2, 0, 3600.0, 0.1, 1, 202, False)])
    points = L.timeline(attempts, runs(spark, "r"))
    assert rows(points, "t", "requests") == sorted(((t, int(t in (0, 4, 3600))) for t in range(3601)), key=repr)
    assert rows(L.thin_timeline(points, most=2), "t") == [(0,), (1801,)]


def test_comparison(spark):
    attempts = log(spark, [("a", i, 0, i, 0.010, 10, 202, False) for i in range(10)] + [("b", i, 0, i, 0.005, 10, 202 if i else 429, False) for i in range(10)])
    records = L.run_records(attempts, runs(spark, "a", "b"))
    pair = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    got = {r["measure"]: (r["change"], r["verdict"]) for r in L.compare_runs(records, pair).collect()}
    assert got["Accepted"] == ("−10 (−10%)", "worse")
    assert got["Requests told to slow down (429)"] == ("+1", "worse")
    assert got["Latency p95"] == ("−5 ms (−50%)", "better")
    assert got["Records sent"] == ("same", "") and got["Request errors"] == ("same", "")
    lines = [r["text"] for r in L.report_lines(records, L.timeline(attempts, runs(spark, "a", "b"))).where("run_id = 'b'").collect()]
    assert "| Sent to | http://h:1 |" in lines and "| Responses | 202 x 9, 429 x 1 |" in lines
    checks = spark.createDataFrame([("a", 1, "ok", "fine")], "run_id string, line_no int, level string, text string")
    points = L.timeline(attempts, runs(spark, "a", "b"))
    document = json.loads(L.run_documents(records, points, checks).where("run_id = 'a'").first()["document"])
    assert document["run"]["accepted"] == 100 and [p["t"] for p in document["timeline"]] == list(range(10))
    assert document["data_check"] == [{"line_no": 1, "level": "ok", "text": "fine"}]
    stored = spark.createDataFrame([("a", 97)], "run_id string, stored bigint")
    closing = {r["run_id"]: r["line"] for r in L.run_outcome(L.run_totals(attempts, runs(spark, "a", "b")), runs(spark, "a", "b"), stored).collect()}
    assert closing == {"a": "Replay done: 100 sent, 97 stored, 0 rejected (3 already stored)",
                       "b": "Replay done: 100 sent, 90 accepted, 0 rejected, 10 gave up after retries"}


def test_histogram_and_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.005, 0.05, 0.3, 0.3, 2.0, 1e9)], "v double")
    hist = M.histogram(df, "v", [0.01, 0.1, 0.5, 1.0, 5.0])
    assert rows(hist, "bucket", "le", "cumulative") == [(0, "0.01", 2), (1, "0.1", 3), (2, "0.5", 5), (3, "1", 5), (4, "5", 6), (5, "+Inf", 7)]
    q = {r["q"]: r["value"] for r in M.histogram_quantile(hist, [0.5, 0.99]).collect()}
    assert q[0.5] == pytest.approx(0.1 + 0.4 * 0.5 / 2) and q[0.99] == 5.0


def test_scrapes(spark):
    text = ['pulse_queue_depth 3', 'pulse_queue_depth_max 9', '# TYPE x', 'pulse_ingest_events_total{outcome="accepted",x="1"} 5',
            'pulse_ingest_events_total{outcome="accepted",x="2"} 6', 'pulse_processed_events_total{outcome="stored"} 4']
    lines = spark.createDataFrame([(1, x) for x in text], "t int, line string")
    r = M.scrape_series(lines).first()
    assert (r["queue_depth"], r["accepted"], r["stored"], r["failed"]) == (3, 11, 4, None)
    assert M.sample_sum(M.sample_values(lines), "nope").first()[0] is None


@pytest.mark.parametrize("pieces", [None, 10])
def test_counter_deltas(spark, pieces):
    series = spark.createDataFrame([("a", i, float(i * i)) for i in range(50)] + [("b", 0, 1.0)], "metric string, t int, value double")
    got = dict(rows(M.counter_deltas(series, pieces).where("metric = 'a'"), "t", "delta"))
    assert got == {i: (float(2 * i - 1) if i else None) for i in range(50)}


def test_metrics_as_of(spark):
    series = spark.createDataFrame([("r", t, t * 10) for t in range(10, 100, 10)], "run string, t int, depth int")
    asked = spark.createDataFrame([("r", t) for t in (5, 10, 25, 25, 99)], "run string, asked int")
    expected = [(5, None), (10, 100), (25, 200), (25, 200), (99, 900)]
    assert rows(M.metrics_as_of(asked, series, ["run"]), "asked", "depth") == sorted(expected, key=repr)


def test_failures_and_stored_rows(spark):
    failures = spark.createDataFrame([("persist",), ("persist",)], "stage string")
    assert rows(M.failure_stages(failures), "stage", "n") == [("alert_persist", 0), ("persist", 2), ("shutdown_drop", 0)]


def test_growth_of_a_counter_between_two_moments(spark):
    values = [5.0, 7.0, 7.0, 20.0, 3.0, 4.0, 1.0, 10.0]  # begins anew at 40 and 60
    series = spark.createDataFrame([(10 * t, v) for t, v in enumerate(values)], "t long, value double")
    spans = [("all", 0, 70), ("early", -50, 15), ("before", -50, -10), ("inside", 15, 35), ("reset", 35, 45), ("two", 30, 65), ("late", 65, 500), ("none", 41, 49)]
    df = spark.createDataFrame(spans, "run_id string, from_t long, to_t long")

    def total(t):
        seen = [v for i, v in enumerate(values) if 10 * i <= t]
        return sum(b - a if b >= a else b for a, b in zip(seen, seen[1:])) if seen else None  # noqa: B905

    want = [(r, None if total(b) is None else total(b) - (total(a) or 0.0)) for r, a, b in spans]
    assert rows(M.growth_between(series, df), "run_id", "growth") == sorted(want, key=repr)


def test_comparison_has_texts_beside_measures(spark):
    slow = '{"rate_per_s":50,"ramp_to_per_s":200,"ramp_s":10,"speed":2,"batch_size":20,"concurrency":1}'
    cells = dict.fromkeys(["records_done", "accepted", "peak_sent_per_s", "peak_accepted_per_s", "throttled", "request_errors"], 10) | {"p95_ms": 1.5, "p99_ms": None, "max_ms": 3.0, "elapsed_s": 2.04}
    made = [("a", "2025-01-01 10:00:00", "http://one", "x.csv", '{"batch_size":5,"concurrency":3}', None, None), ("b", "2025-01-02 10:00:00", None, "", slow, 4, 120)]
    df = spark.createDataFrame(made, "run_id string, started_at string, target string, source string, config string, first_throttled_at_s int, sent_per_s_at_first_throttle long")
    records = df.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumns({k: F.lit(v).cast("double") for k, v in cells.items()})
    pairs = spark.createDataFrame([("a", "b")], "run_a string, run_b string")
    shown = {r["measure"]: (r["shown_a"], r["shown_b"]) for r in L.compare_runs(records, pairs).collect()}
    assert len(shown) == 15
    assert shown["Started"] == ("2025-01-01 10:00:00", "2025-01-02 10:00:00")
    assert shown["Sent to"] == ("http://one", "–") and shown["Data"] == ("x.csv", "–")
    assert shown["Pace"] == ("as fast as possible, batches of 5, 3 connections", "ramp 50→200/s over 10 s, 2× recorded, batches of 20, 1 connection")
    assert shown["First 429"] == ("none", "at 4 s (120/s)")
    assert shown["Took"] == ("2 s", "2 s") and shown["Latency p95"] == ("1.5 ms", "1.5 ms") and shown["Latency p99"] == (None, None)
