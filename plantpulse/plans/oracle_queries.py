"""One SQL text per registered query that SQL can express."""

from __future__ import annotations

from plantpulse.plans.oracle import (
    ALERTS, CHECKED, COMPARED, DEDUPED, GOOD, IMPORTED, LABELS, LOG, OUTCOMES, READING, REASONS, RECORD, REPORT, REPORT_TOTALS, SRC, TOTALS,
    fired, first_wins, histogram_sql, millis, nano, number,
)
from plantpulse.schemas import LAG_BOUNDS, LATENCY_BOUNDS

SQL: dict[str, str] = {}


def add(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"WITH {ctes}\n{body}" if ctes else body


# --- validation -------------------------------------------------------------
add("alert_counts_by_device", GOOD + fired("good"),
    "SELECT device_id, rule, count(*) AS n, max(observed) AS max_observed FROM fired GROUP BY 1, 2")
for name, ctes, rows in (("validation_reasons", CHECKED, "checked"), ("validation_reasons_with_duplicates", DEDUPED, "deduped")):
    add(name, ctes, f"SELECT r.reason, count(c.reason) AS n FROM {REASONS} LEFT JOIN {rows} c ON c.reason = r.reason GROUP BY 1")
add("validated_events", GOOD, f"""
SELECT batch_id, CAST(idx AS INTEGER) AS idx, row_no, event_id, device_id, site_id, CAST(schema_version AS INTEGER) AS schema_version,
       {nano('event_time')} AS event_time, {nano('received_at')} AS received_at, sequence, temperature_c, vibration_mm_s FROM good""")
add("dead_letters", DEDUPED, "SELECT batch_id, CAST(idx AS INTEGER) AS idx, reason, detail FROM deduped WHERE reason IS NOT NULL")
add("batch_response", DEDUPED + """,
bad AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS r FROM deduped WHERE reason IS NOT NULL),
by_reason AS (SELECT batch_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS counts
  FROM (SELECT batch_id, reason, count(*) AS n FROM bad GROUP BY 1, 2) GROUP BY 1),
firsts AS (SELECT batch_id, string_agg(idx || ':' || reason, ',' ORDER BY idx) AS shown FROM bad WHERE r <= 50 GROUP BY 1)""", """
SELECT d.batch_id, count(*) AS received, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected,
       any_value(b.counts) AS counts, any_value(f.shown) AS shown, count(*) FILTER (reason IS NOT NULL) > 50 AS rejections_truncated, 202 AS status
FROM deduped d LEFT JOIN by_reason b USING (batch_id) LEFT JOIN firsts f USING (batch_id) GROUP BY d.batch_id""")
add("batch_envelopes", RECORD, """
SELECT batch_id, CAST(count(*) AS INTEGER) AS n_events, CASE WHEN count(*) > 500 THEN 413 END AS status,
       CASE WHEN count(*) > 500 THEN 'batch_too_large' END AS error, CASE WHEN count(*) > 500 THEN 'too many events in one request' END AS detail
FROM record GROUP BY 1""")
ENVELOPE_TEXTS = "CASE fault " + " ".join(
    f"WHEN '{fault}' THEN '{text}'" for fault, text in {
        "invalid_json": 'body must be a JSON object like {"events":[...]}', "trailing": "unexpected data after the JSON object", "empty_batch": "events must contain at least one record", "payload_too_large": "request body exceeds the configured limit", "batch_too_large": "too many events in one request",
    }.items()) + " END"
# A request is judged at one moment: the arrival of its last record.
ONE_MOMENT = "FROM (SELECT * REPLACE (max(received_at) OVER (PARTITION BY batch_id) AS received_at) FROM record)),\nchecked AS"
add("payload_reasons", DEDUPED.replace("FROM record),\nchecked AS", ONE_MOMENT), """
SELECT batch_id, outcome, CASE WHEN outcome = 'batch_too_large' THEN 1 ELSE count(*) END AS n FROM (
  SELECT batch_id, CASE WHEN count(*) OVER (PARTITION BY batch_id) > 500 THEN 'batch_too_large' ELSE coalesce(reason, 'accepted') END AS outcome
  FROM (SELECT batch_id, reason FROM deduped)) GROUP BY 1, 2""")
add("payload_shapes", DEDUPED.replace("FROM record),\nchecked AS", ONE_MOMENT), """
SELECT shape, count(*) AS records, count(*) FILTER (reason IS NULL) AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS place FROM checked), (VALUES ('batch'), ('array'), ('ndjson'), ('single')) s(shape)
WHERE shape <> 'single' OR place = 1 GROUP BY 1""")
add("envelope_faults", RECORD + """,
request AS (SELECT batch_id, CAST(batch_id AS INTEGER) % 6 AS fault, count(*) AS n FROM record GROUP BY 1),
named AS (SELECT batch_id, CASE fault WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'empty_batch' WHEN 3 THEN 'trailing' WHEN 4 THEN 'empty_batch' WHEN 5 THEN 'payload_too_large'
  ELSE CASE WHEN n > 500 THEN 'batch_too_large' END END AS fault FROM request)""", """
SELECT batch_id, CASE WHEN fault IS NULL THEN NULL WHEN fault IN ('payload_too_large', 'batch_too_large') THEN 413 ELSE 400 END AS status,
       CASE fault WHEN 'trailing' THEN 'invalid_json' ELSE fault END AS error, DETAIL AS detail FROM named""".replace("DETAIL", ENVELOPE_TEXTS))
add("rejection_examples", CHECKED + """,
bad AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY row_no) AS r, count(*) OVER (PARTITION BY reason) AS n
  FROM checked WHERE reason IS NOT NULL)""",
    f"SELECT reason, {LABELS} AS label, n, CAST(r AS INTEGER) AS example, row_no AS \"row\", detail FROM bad WHERE r <= 3")

# --- uniqueness -------------------------------------------------------------
add("dedup_in_batch", DEDUPED, "SELECT batch_id, CAST(idx AS INTEGER) AS idx, event_id, device_id, sequence FROM deduped WHERE reason IS NULL")
add("insert_new", OUTCOMES, "SELECT batch_id, CAST(idx AS INTEGER) AS idx, event_id, outcome FROM outcomes")
add("persist_outcomes", OUTCOMES, """
SELECT batch_id, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'duplicate') AS duplicate,
       CAST(0 AS BIGINT) AS failed FROM outcomes GROUP BY 1""")
add("processed_outcomes", OUTCOMES, """
SELECT v.outcome, count(o.outcome) AS n FROM (VALUES ('stored'), ('duplicate'), ('failed')) v(outcome)
LEFT JOIN outcomes o ON o.outcome = v.outcome GROUP BY 1""")
add("replay_idempotence", "", "SELECT CAST(0 AS BIGINT) AS stored, count(*) AS duplicate, CAST(0 AS BIGINT) AS alerts FROM events")
add("conservation_check", OUTCOMES, """
SELECT d.batch_id, d.received, d.accepted, d.refused, coalesce(o.stored, 0) AS stored, coalesce(o.duplicate, 0) AS duplicate,
       CAST(0 AS BIGINT) AS refused_but_stored,
       d.accepted + d.refused = d.received AND coalesce(o.stored, 0) + coalesce(o.duplicate, 0) = d.accepted AS conserved
FROM (SELECT batch_id, count(*) AS received, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS refused
      FROM deduped GROUP BY 1) d
LEFT JOIN (SELECT batch_id, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'duplicate') AS duplicate
      FROM outcomes GROUP BY 1) o USING (batch_id)""")

# --- alerts -----------------------------------------------------------------
ALERT_COLUMNS = f"alert_id, device_id, event_id, rule, threshold, observed, {nano('event_time')} AS event_time, {nano('created_at')} AS created_at"
add("alerts_all", ALERTS, f"SELECT {ALERT_COLUMNS} FROM fired")
add("alerts_threshold_history", READING + """,
setting AS (SELECT min(ts) AS valid_from, 80.0::DOUBLE + day(any_value(ts)) % 7 AS tl, (70 + day(any_value(ts)) % 3)::DOUBLE / 10.0 AS vl
  FROM events GROUP BY CAST(ts AS DATE)),
dated AS (SELECT r.*, s.tl, s.vl FROM reading r ASOF JOIN setting s ON r.received_at >= s.valid_from),
fired AS (
  SELECT event_id || ':temperature_high' AS alert_id, device_id, event_id, 'temperature_high' AS rule, tl AS threshold, temperature_c AS observed,
         event_time, received_at AS created_at FROM dated WHERE temperature_c >= tl
  UNION ALL SELECT event_id || ':vibration_high', device_id, event_id, 'vibration_high', vl, vibration_mm_s, event_time, received_at
  FROM dated WHERE vibration_mm_s >= vl)""", f"SELECT {ALERT_COLUMNS} FROM fired")
add("golden_alerts", ALERTS + """,
listed AS (
  SELECT event_id || ':temperature_high' AS alert_id, device_id, event_id, 'temperature_high' AS rule, CASE WHEN site_id = 'view' THEN 80.0 ELSE 85.0 END::DOUBLE AS threshold, temperature_c AS observed
  FROM reading WHERE site_id <> 'click' AND temperature_c >= CASE WHEN site_id = 'view' THEN 80.0 ELSE 85.0 END
  UNION ALL SELECT event_id || ':vibration_high', device_id, event_id, 'vibration_high', 7.1, vibration_mm_s FROM reading WHERE site_id <> 'click' AND vibration_mm_s >= 7.1),
made AS (SELECT alert_id, device_id, event_id, rule, threshold, observed FROM fired),
rules AS (SELECT unnest(['temperature_high', 'vibration_high']) AS rule)""", """
SELECT rule, (SELECT count(*) FROM listed l WHERE l.rule = r.rule) AS expected, (SELECT count(*) FROM made m WHERE m.rule = r.rule) AS fired,
       (SELECT count(*) FROM (SELECT * FROM listed EXCEPT ALL SELECT * FROM made) x WHERE x.rule = r.rule) AS missing,
       (SELECT count(*) FROM (SELECT * FROM made EXCEPT ALL SELECT * FROM listed) x WHERE x.rule = r.rule) AS unexpected FROM rules r""")
add("alerts_new_only", OUTCOMES + ",\nnewly AS (SELECT * FROM outcomes WHERE outcome = 'stored')" + fired("newly"),
    "SELECT alert_id, device_id, rule, threshold, observed FROM fired")
add("merge_alerts", GOOD + fired("good") + ",\nolder AS (SELECT * FROM src WHERE site_id IN ('click', 'view'))", """
SELECT DISTINCT alert_id, event_id, rule FROM fired f WHERE NOT EXISTS (
  SELECT 1 FROM older o WHERE o.event_id = f.event_id
    AND ((f.rule = 'temperature_high' AND o.temperature_c >= 85.0) OR (f.rule = 'vibration_high' AND o.vibration_mm_s >= 7.1)))""")
add("alert_counts", ALERTS, """
SELECT v.rule, count(f.rule) AS n FROM (VALUES ('temperature_high'), ('vibration_high')) v(rule) LEFT JOIN fired f ON f.rule = v.rule GROUP BY 1""")

# --- query surface ----------------------------------------------------------
TOKEN = "rtrim(replace(replace(to_base64(encode(epoch_us({t}) || '|' || {id})), '+', '-'), '/', '_'), '=')"
EVENT_VIEW = "event_id, device_id, site_id, CAST(schema_version AS INTEGER) AS schema_version, sequence, temperature_c, vibration_mm_s"


def page_sql(name: str, ctes: str, rows: str, row_id: str, columns: str, where: str, limit: int, time: bool = True) -> None:
    shown = f"{columns}, CASE WHEN rn = {limit} AND total > {limit} THEN {TOKEN.format(t='event_time', id=row_id)} END AS next_cursor"
    shown += f", {nano('event_time')} AS event_time" if time else ""
    add(name, ctes + f""",
hits AS (SELECT *, row_number() OVER (ORDER BY event_time, {row_id}) AS rn, count(*) OVER () AS total FROM {rows} WHERE {where})""",
        f"SELECT {shown} FROM hits WHERE rn <= {limit}")


RANGE = "event_time >= TIMESTAMP '2024-01-10 06:00:00' AND event_time < TIMESTAMP '2024-01-11 06:00:00'"
page_sql("events_page1", READING, "reading", "event_id", EVENT_VIEW, RANGE, 100)
page_sql("events_page_after_cursor", READING, "reading", "event_id", EVENT_VIEW,
         RANGE + " AND (event_time, event_id) > (TIMESTAMP '2024-01-10 10:00:00', 'ev-0')", 50)
page_sql("events_of_device", READING, "reading", "event_id", EVENT_VIEW, RANGE + " AND device_id = 'dev-00000008'", 1000, time=False)
page_sql("alerts_page", ALERTS, "fired", "alert_id", "alert_id, device_id, rule, threshold, observed", RANGE, 100)
add("cursor_tokens", READING, f"""
SELECT event_id, {TOKEN.format(t='event_time', id='event_id')} AS token, event_id AS decoded_id, epoch_us(event_time) AS decoded_us FROM reading""")
add("walk_pages", READING, "SELECT event_id, CAST((row_number() OVER (ORDER BY event_time, event_id) - 1) // 250 AS BIGINT) AS page FROM reading")
add("newest_alerts", ALERTS, f"""
SELECT alert_id, rule, {nano('created_at')} AS created_at FROM (SELECT * FROM fired ORDER BY created_at DESC, alert_id DESC LIMIT 100)""")
add("run_history", TOTALS, f"""
SELECT run_id, 'done' AS state, {nano('started_at')} AS started_at FROM (SELECT * FROM run ORDER BY started_at DESC, run_id DESC LIMIT 30)""")
add("storage_stats", ALERTS, f"""
SELECT count(*) AS events, count(DISTINCT device_id) AS devices, {nano('min(event_time)')} AS first_event, {nano('max(event_time)')} AS last_event,
       (SELECT count(*) FROM fired) AS alerts FROM reading""")
add("device_counts", READING, "SELECT device_id, count(*) AS events FROM reading GROUP BY 1")
LATEST = READING + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY received_at DESC, event_id DESC) AS r FROM reading),
latest AS (SELECT * FROM ranked WHERE r = 1)"""
add("latest_per_device", LATEST, f"SELECT device_id, event_id, {nano('event_time')} AS event_time, temperature_c, vibration_mm_s FROM latest")
add("recent_trend", LATEST, """
SELECT device_id, CAST(count(*) AS INTEGER) AS points,
       string_agg(CAST(temperature_c AS VARCHAR), ' ' ORDER BY r DESC) AS temperature_values, least(min(temperature_c), 85.0) AS temperature_low,
       greatest(max(temperature_c), 85.0) AS temperature_high, CAST(count(*) FILTER (temperature_c >= 85.0) AS INTEGER) AS temperature_hits,
       string_agg(CAST(vibration_mm_s AS VARCHAR), ' ' ORDER BY r DESC) AS vibration_values, least(min(vibration_mm_s), 7.1) AS vibration_low,
       greatest(max(vibration_mm_s), 7.1) AS vibration_high, CAST(count(*) FILTER (vibration_mm_s >= 7.1) AS INTEGER) AS vibration_hits
FROM ranked WHERE r <= 60 GROUP BY 1""")
RULES = "concat_ws(',', CASE WHEN temperature_c >= 85.0 THEN 'temperature_high' END, CASE WHEN vibration_mm_s >= 7.1 THEN 'vibration_high' END)"
add("highlight_alerts", LATEST, f"SELECT event_id, device_id, temperature_c, vibration_mm_s, {RULES} AS fired, {RULES} AS marked FROM latest")
add("state_as_of", READING + """,
seen AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC) AS r FROM reading
  WHERE n <= (SELECT max(event_id) // 2 FROM events))""",
    f"SELECT device_id, event_id, temperature_c, {RULES} AS fired FROM seen WHERE r = 1")
add("states_as_of", READING + """,
asked AS (SELECT (SELECT max(event_id) // 10 FROM events) * i AS asked FROM generate_series(1, 10) g(i))""", """
SELECT CAST(asked AS BIGINT) AS asked, device_id, count(*) AS events, arg_max(event_id, n) AS event_id
FROM asked JOIN reading ON n <= asked GROUP BY 1, 2""")

# --- data-quality report ----------------------------------------------------
add("device_report", REPORT, "SELECT * FROM report")
add("worst_devices", REPORT, "SELECT * FROM listed")
add("usual_interval", REPORT, "SELECT device, usual_interval_seconds FROM report WHERE usual_interval_seconds > 0")
add("gaps", REPORT, "SELECT device, gaps, longest_gap_seconds, usual_interval_seconds FROM report WHERE gaps > 0")
add("stuck_runs", REPORT, "SELECT device, stuck_runs FROM report WHERE stuck_runs > 0")
add("out_of_order", REPORT, "SELECT device, out_of_order FROM report WHERE out_of_order > 0")
add("duplicate_ids", IMPORTED, "SELECT CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicate_ids FROM rows")
add("duplicate_readings", IMPORTED,
    "SELECT device_id, CAST(count(*) - count(DISTINCT time_text) AS BIGINT) AS duplicate_readings FROM rows GROUP BY 1")
add("value_stats", IMPORTED, """
SELECT 'temperature_c' AS field, count(temperature_c) AS n, min(temperature_c) AS min_value, max(temperature_c) AS max_value,
       round(avg(temperature_c), 6) AS mean_value FROM rows
UNION ALL SELECT 'vibration_mm_s', count(vibration_mm_s), min(vibration_mm_s), max(vibration_mm_s), round(avg(vibration_mm_s), 6) FROM rows""")
add("report_totals", REPORT_TOTALS, "SELECT * FROM totals")
HUMAN = "CASE WHEN {s} < 90 THEN printf('%.0f s', {s}) WHEN {s} < 5400 THEN printf('%.1f min', {s} / 60) ELSE printf('%.1f h', {s} / 3600) END"
add("findings", REPORT_TOTALS + f""",
reasons AS (SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY 1),
parts AS (SELECT string_agg(n || ' ' || {LABELS}, ', ' ORDER BY n DESC, reason) AS parts FROM reasons),
wg AS (SELECT * FROM report ORDER BY longest_gap_seconds DESC, gaps + out_of_order + stuck_runs DESC, device LIMIT 1),
ws AS (SELECT * FROM report ORDER BY stuck_runs DESC, gaps + out_of_order + stuck_runs DESC, device LIMIT 1),
lines AS (
  SELECT 1 AS o, 'problem' AS level, rejected || ' of ' || "rows" || ' rows (' || printf('%.1f', 100.0::DOUBLE * rejected / "rows")
         || '%) would be rejected by the schema checks: ' || (SELECT parts FROM parts) || '.' AS text FROM totals WHERE rejected > 0
  UNION ALL SELECT 2, 'warning', duplicate_ids || CASE WHEN duplicate_ids = 1 THEN ' row has an' ELSE ' rows have an' END
         || ' event_id already used by an earlier row. A service that ignores repeated ids will store '
         || CASE WHEN duplicate_ids = 1 THEN 'it' ELSE 'them' END || ' once.' FROM totals WHERE duplicate_ids > 0
  UNION ALL SELECT 3, 'warning', duplicate_readings || CASE WHEN duplicate_readings = 1 THEN ' row has' ELSE ' rows have' END
         || ' the same device and time as an earlier row.' FROM totals WHERE duplicate_readings > 0
  UNION ALL SELECT 4, 'warning', out_of_order || CASE WHEN out_of_order = 1 THEN ' row is' ELSE ' rows are' END
         || ' older than an earlier row of the same device, so the file is not in time order for '
         || CASE WHEN out_of_order = 1 THEN 'it' ELSE 'them' END || '.' FROM totals WHERE out_of_order > 0
  UNION ALL SELECT 5, 'warning', t.gaps || ' unusually long ' || CASE WHEN t.gaps = 1 THEN 'silence' ELSE 'silences' END
         || ' in the readings (more than 3 times the usual spacing). The longest is ' || {HUMAN.format(s='w.longest_gap_seconds')} || ' on ' || w.device
         || ', where readings usually come every ' || {HUMAN.format(s='w.usual_interval_seconds')} || '.' FROM totals t, wg w WHERE t.gaps > 0
  UNION ALL SELECT 6, 'warning', t.stuck_runs || CASE WHEN t.stuck_runs = 1 THEN ' run' ELSE ' runs' END
         || ' of 10 or more identical values in a row, which can mean a stuck sensor (most on ' || w.device || ').' FROM totals t, ws w WHERE t.stuck_runs > 0)""",
    "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS line_no, level, text FROM lines")

# --- delivery log -----------------------------------------------------------
add("record_outcomes", LOG, """
SELECT run_id, CAST(batch_no AS INTEGER) AS batch_no, CAST(attempt_no AS INTEGER) AS attempt_no, kind, CAST(accepted AS INTEGER) AS accepted,
       CAST(rejected AS INTEGER) AS rejected, CAST(gave_up AS INTEGER) AS gave_up, CAST(errored AS INTEGER) AS errored FROM outcome""")
add("run_totals", TOTALS, """
SELECT run_id, CAST(planned AS INTEGER) AS planned, CAST(batches AS INTEGER) AS batches, round(elapsed_s, 6) AS elapsed_s, batches_done,
       CAST(records_done AS BIGINT) AS records_done, CAST(accepted AS BIGINT) AS accepted, CAST(rejected AS BIGINT) AS rejected, throttled, retries,
       CAST(gave_up_records AS BIGINT) AS gave_up_records, request_errors, CAST(errored_records AS BIGINT) AS errored_records,
       round(records_done / elapsed_s, 6) AS throughput_per_s FROM run JOIN total USING (run_id)""")
add("rejection_totals", LOG, """
SELECT run_id, 'missing_field' AS reason, CAST(sum(rejected) AS BIGINT) AS n FROM outcome GROUP BY 1 HAVING sum(rejected) > 0""")
add("status_counts", LOG, "SELECT run_id, CAST(status AS INTEGER) AS status, count(*) AS n FROM attempt WHERE status IS NOT NULL GROUP BY 1, 2")
add("latency_summary", TOTALS, "SELECT * FROM latency")
add("first_error", TOTALS, "SELECT run_id, CAST(batch AS INTEGER) AS batch, CAST(status AS INTEGER) AS status, message, body FROM first_bad")
add("timeline", TOTALS, "SELECT * FROM point")
add("timeline_summary", TOTALS, "SELECT * FROM summary")
add("thin_timeline", TOTALS + ",\nstep AS (SELECT run_id, CAST(greatest(1, ceil(count(*) / 120.0)) AS INTEGER) AS step FROM point GROUP BY 1)",
    "SELECT run_id, t, step, requests, sent, records FROM point JOIN step USING (run_id) WHERE t % step = 0")
add("run_records", TOTALS, """
SELECT run_id, strftime(started_at, '%Y%m%dT%H%M%S.%g') || 'Z' AS id, 'http://host-' || run_no || ':8080' AS target, CAST(planned AS INTEGER) AS planned,
       CAST(records_done AS BIGINT) AS records_done, CAST(accepted AS BIGINT) AS accepted, CAST(rejected AS BIGINT) AS rejected, throttled, retries,
       request_errors, p50_ms, p95_ms, p99_ms, max_ms, peak_sent_per_s, peak_accepted_per_s, first_throttled_at_s, first_error_at_s,
       message
FROM run JOIN total USING (run_id) JOIN latency USING (run_id) JOIN summary USING (run_id) LEFT JOIN first_bad USING (run_id)""")
SIGN = "CASE WHEN b > a THEN '+' ELSE '−' END"
add("compare_runs", COMPARED, f"""
SELECT run_a, run_b, CAST(no AS INTEGER) AS no, measure, a, b, shown_a, shown_b, round(b - a, 2) AS difference,
       CASE WHEN a <> 0 THEN CAST(round(abs(100 * (b - a) / a), 0) AS BIGINT) END AS percent,
       CASE WHEN b = a THEN 'same' ELSE {SIGN} || {number('round(abs(b - a), 2)')} || unit
            || coalesce(' (' || {SIGN} || CASE WHEN a <> 0 THEN CAST(round(abs(100 * (b - a) / a), 0) AS BIGINT) END || '%)', '') END AS change,
       CASE WHEN better = '' OR a = b THEN '' WHEN (b > a) = (better = 'higher') THEN 'better' ELSE 'worse' END AS verdict
FROM sides""")
EXAMPLES = CHECKED + """,
bad AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY row_no) AS r, count(*) OVER (PARTITION BY reason) AS n
  FROM checked WHERE reason IS NOT NULL)"""
add("report_lines", EXAMPLES + ",\n" + TOTALS.replace("judged AS (", "weighed AS (").replace("FROM judged)", "FROM weighed)") + f""",
grouped AS (SELECT reason, {LABELS} AS label, any_value(n) AS n, string_agg('row ' || row_no || ': ' || replace(detail, '|', '\\|'), '; ' ORDER BY row_no) AS examples
  FROM bad WHERE r <= 3 GROUP BY reason),
facts AS (SELECT r.run_id, r.run_no, r.started_at, r.elapsed_s, r.planned, t.* EXCLUDE (run_id), l.* EXCLUDE (run_id), s.* EXCLUDE (run_id), b.* EXCLUDE (run_id, status),
    records_done / elapsed_s AS rate
  FROM run r JOIN total t USING (run_id) JOIN latency l USING (run_id) JOIN summary s USING (run_id) LEFT JOIN first_bad b USING (run_id)),
answers AS (SELECT run_id, string_agg(status || ' x ' || n, ', ' ORDER BY status) AS answers
  FROM (SELECT run_id, status, count(*) AS n FROM attempt WHERE status IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
thin AS (SELECT run_id, CAST(greatest(1, ceil(count(*) / 120.0)) AS INTEGER) AS step FROM point GROUP BY 1),
lines AS (
  SELECT run_id, 'head' AS section, 1 AS line_no, '# Replay report' AS text FROM facts
  UNION ALL SELECT run_id, 'head', 2, 'Run started ' || strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') || ', state: **done**, took ' || printf('%.1f', elapsed_s) || ' s.' FROM facts
  UNION ALL SELECT run_id, 'setup', 1, '| Sent to | http://host-' || run_no || ':8080 |' FROM facts
  UNION ALL SELECT run_id, 'setup', 2, '| Data | generated data |' FROM facts
  UNION ALL SELECT run_id, 'setup', 3, '| Pace | as fast as possible |' FROM facts
  UNION ALL SELECT run_id, 'setup', 4, '| Batch size / connections | 50 / 8 |' FROM facts
  UNION ALL SELECT run_id, 'setup', 5, '| Retries on 429 | 1 |' FROM facts
  UNION ALL SELECT run_id, 'results', 1, '| Records sent | ' || records_done || ' of ' || planned || ' planned |' FROM facts
  UNION ALL SELECT run_id, 'results', 2, '| Accepted | ' || accepted || ' |' FROM facts
  UNION ALL SELECT run_id, 'results', 3, '| Rejected as invalid | ' || rejected || ' |' FROM facts
  UNION ALL SELECT run_id, 'results', 4, '| Told to slow down (429) | ' || throttled || ' times, ' || retries || ' retries, ' || gave_up_records || ' records given up |' FROM facts
  UNION ALL SELECT run_id, 'results', 5, '| Request errors | ' || request_errors || ' (' || errored_records || ' records) |' FROM facts
  UNION ALL SELECT run_id, 'results', 6, '| Average throughput | ' || printf('%.0f', rate) || ' records/s |' FROM facts
  UNION ALL SELECT run_id, 'results', 7, '| Request latency | p50 ' || {number('p50_ms')} || ' ms, p95 ' || {number('p95_ms')} || ' ms, p99 ' || {number('p99_ms')} || ' ms, max ' || {number('max_ms')} || ' ms |' FROM facts
  UNION ALL SELECT run_id, 'results', 8, '| Responses | ' || answers || ' |' FROM answers
  UNION ALL SELECT run_id, 'results', 9, '| First problem | request ' || batch || ': ' || message || coalesce(' - ' || body, '') || ' |' FROM facts WHERE message IS NOT NULL
  UNION ALL SELECT run_id, 'over_time', 1, '- Sent up to ' || peak_sent_per_s || ' records a second; the service accepted up to ' || peak_accepted_per_s || '.' FROM facts
  UNION ALL SELECT run_id, 'over_time', 2, '- First told to slow down (429) at ' || first_throttled_at_s || ' s, when about ' || sent_per_s_at_first_throttle || ' records a second were being sent.' FROM facts WHERE first_throttled_at_s IS NOT NULL
  UNION ALL SELECT run_id, 'over_time', 3, '- First error at ' || first_error_at_s || ' s, at about ' || sent_per_s_at_first_error || ' records a second.' FROM facts WHERE first_error_at_s IS NOT NULL
  UNION ALL SELECT run_id, 'over_time', 4, '- The slowest 5% of requests took ' || {number('p95_first_ms')} || ' ms at the start and ' || {number('p95_last_ms')} || ' ms at the end.' FROM facts
  UNION ALL SELECT p.run_id, 'seconds', p.t + 1, '| ' || p.t || ' | ' || sent || ' | ' || records || ' | ' || requests || ' | ' || throttled || ' | ' || errors || ' | ' || {number('p95_ms')} || ' |'
  FROM point p JOIN thin USING (run_id) WHERE p.t % step = 0
  UNION ALL SELECT run_id, 'seconds_head', 1, '| Second | Sent | Accepted | Requests | 429 | Errors | p95 ms |' FROM facts
  UNION ALL SELECT run_id, 'seconds_head', 2, '|---:|---:|---:|---:|---:|---:|---:|' FROM facts
  UNION ALL SELECT run_id, 'seconds_note', 1, 'Every ' || step || ' seconds are shown.' FROM thin WHERE step > 1
  UNION ALL SELECT 'run-00000', 'data_head', 1, '## Data check of dirty\\|records'
  UNION ALL SELECT 'run-00000', 'data_head', 2, count(*) || ' rows, ' || count(DISTINCT device_id) FILTER (NOT broken) || ' devices.' FROM record
  UNION ALL SELECT 'run-00000', 'rejections', CAST(row_number() OVER (ORDER BY n DESC, reason) AS INTEGER), '  - ' || n || ' x ' || label || ' (' || examples || ')' FROM grouped
  UNION ALL SELECT run_id, 'footer', 1, 'Addresses are shown without their query string and header values are never included. Readings sent to your own service are not stored. Rows are counted after a file''s header.' FROM facts)""", "SELECT * FROM lines")
add("run_outcome", TOTALS + """,
grown AS (SELECT event_id AS n, sum(g) OVER (ORDER BY event_id) AS total FROM (
  SELECT event_id, CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END AS g FROM (
    SELECT event_id, event_id * 2 % 9000 AS v, lag(event_id * 2 % 9000) OVER (ORDER BY event_id) AS b FROM events))),
ends AS (SELECT run_id, max(n) AS last, any_value(run_no) * 2500 AS first FROM attempt GROUP BY 1),
added AS (SELECT run_id, CAST(b.total - coalesce((SELECT max(g.total) FROM grown g WHERE g.n <= first), 0) AS BIGINT) AS stored FROM ends JOIN grown b ON b.n = last),
told AS (SELECT *, CASE WHEN NOT outside AND accepted > stored THEN CAST(accepted - stored AS BIGINT) END AS already FROM run JOIN total USING (run_id) JOIN added USING (run_id))""", """
SELECT run_id, round(least(100.0::DOUBLE, 100.0::DOUBLE * records_done / planned), 1) AS progress_percent, already AS already_stored,
       'Replay done: ' || records_done || CASE WHEN outside
         THEN ' sent to http://host-' || run_no || ':8080, ' || accepted || ' accepted, ' || errored_records || ' failed'
              || CASE WHEN throttled = 0 THEN '' WHEN throttled = 1 THEN ', answered 429 1 time' ELSE ', answered 429 ' || throttled || ' times' END
         ELSE ' sent, ' || stored || ' stored, ' || rejected || ' rejected' || coalesce(' (' || already || ' already stored)', '') END
       || CASE WHEN gave_up_records > 0 THEN ', ' || gave_up_records || ' gave up after retries' ELSE '' END AS line
FROM told""")
add("redacted_targets", TOTALS, "SELECT run_id, 'http://host-' || run_no || ':8080' AS shown, 'http://host-' || run_no || ':8080/api' AS saved FROM run")

# --- counters ---------------------------------------------------------------
add("ingest_outcomes", LOG, """
SELECT 'accepted' AS outcome, CAST(sum(CASE WHEN status = 202 THEN aa ELSE 0 END) AS BIGINT) AS n FROM attempt
UNION ALL SELECT 'rejected_invalid', CAST(sum(CASE WHEN status IN (202, 429, 503) THEN ar ELSE 0 END) AS BIGINT) FROM attempt
UNION ALL SELECT 'rejected_overload', CAST(sum(CASE WHEN status = 429 THEN n_records - ar ELSE 0 END) AS BIGINT) FROM attempt
UNION ALL SELECT 'rejected_shutdown', CAST(sum(CASE WHEN status = 503 THEN n_records - ar ELSE 0 END) AS BIGINT) FROM attempt""")
LAG = GOOD + ",\nlagged AS (SELECT (epoch_us(received_at) - epoch_us(event_time)) / 1000000.0::DOUBLE AS lag_s FROM good)"
add("lag_histogram", LAG, f"SELECT * REPLACE (round(total, 3) AS total) FROM ({histogram_sql('lagged', 'lag_s', LAG_BOUNDS)})")
BOUND_ROWS = ", ".join(f"({i}, {b!r}::DOUBLE)" for i, b in enumerate(LAG_BOUNDS))
add("lag_quantiles", LAG + f""",
bound AS (SELECT * FROM (VALUES {BOUND_ROWS}) b(i, ub)),
cum AS (SELECT i, ub, count(*) FILTER (lag_s <= ub) AS c, count(*) AS n FROM lagged CROSS JOIN bound GROUP BY 1, 2),
edge AS (SELECT *, coalesce(lag(ub) OVER (ORDER BY i), 0) AS lo, coalesce(lag(c) OVER (ORDER BY i), 0) AS before FROM cum),
ask AS (SELECT * FROM (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) a(q)),
hit AS (SELECT q, min(i) AS i FROM ask JOIN edge ON c >= q * n GROUP BY 1)""",
    "SELECT q, round(lo + (ub - lo) * (q * n - before) / (c - before), 6) AS value FROM hit JOIN edge USING (i)")
add("attempt_durations", LOG, f"SELECT * REPLACE (round(total, 6) AS total) FROM ({histogram_sql('attempt', 'latency', LATENCY_BOUNDS, 'run_id')})")
ACCESS = """access AS (
  SELECT '/api/v1/' || event_type AS route, CASE WHEN event_id % 19 = 0 THEN 400 WHEN event_id % 23 = 0 THEN 429 ELSE 200 END AS code,
         value / 1000.0 AS seconds FROM events)"""
add("request_counts", ACCESS, "SELECT route, code, count(*) AS n FROM access GROUP BY 1, 2")
add("request_latency", ACCESS, f"SELECT * REPLACE (round(total, 6) AS total) FROM ({histogram_sql('access', 'seconds', LATENCY_BOUNDS, 'route')})")
SERIES = {"queue_depth": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 17", "accepted": "event_id * 3", "rejected_invalid": "event_id // 7",
          "rejected_overload": "event_id // 11", "stored": "event_id * 2", "duplicate": "event_id // 5", "failed": "event_id // 1000"}
add("scrape_series", "", "SELECT event_id AS t, " + ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in SERIES.items()) + " FROM events")
add("scrape_sums", "", "SELECT event_id AS t, CAST(event_id * 3 AS DOUBLE) AS value FROM events")
add("counter_deltas", "sample AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, event_id AS t, CAST({e} AS DOUBLE) AS value FROM events" for c, e in SERIES.items()) + ")",
    "SELECT metric, t, value, value - lag(value) OVER (PARTITION BY metric ORDER BY t) AS delta FROM sample")
add("metrics_as_of", """asked AS (SELECT epoch_us(ts) - event_id % 7 * 60000000 AS asked FROM events),
series AS (SELECT epoch_us(ts) AS t, event_id AS sample FROM events)""",
    "SELECT a.asked, s.t AS sample_t, s.sample FROM asked a ASOF LEFT JOIN series s ON a.asked >= s.t")

# --- rebase, exports, frames ------------------------------------------------
ANCHOR = "TIMESTAMP '2025-06-01 00:00:00'"
add("rebase_latest", RECORD + ",\nlast AS (SELECT max(event_time) AS m FROM record WHERE NOT broken)", f"""
SELECT row_no, CASE WHEN broken THEN NULL WHEN event_time IS NULL THEN time_text
       ELSE {millis(f"(event_time + ({ANCHOR} - m))")} END AS event_time FROM record, last""")
add("rebase_first", READING + ",\nfirst AS (SELECT arg_min(event_time, n) AS m FROM reading)",
    f"SELECT n AS row_no, {millis(f'(event_time + ({ANCHOR} - m))')} AS event_time FROM reading, first")
add("export_events_csv_rows", READING, f"""
SELECT event_id, device_id, site_id, {nano('event_time')} AS event_time, {nano('received_at')} AS received_at,
       coalesce(CAST(sequence AS VARCHAR), '') AS sequence, {number('temperature_c')} AS temperature_c, {number('vibration_mm_s')} AS vibration_mm_s FROM reading""")
add("export_alerts_csv_rows", ALERTS, f"""
SELECT alert_id, device_id, event_id, rule, {number('threshold')} AS threshold, {number('observed')} AS observed, {nano('event_time')} AS event_time,
       {nano('created_at')} AS created_at FROM fired""")
add("export_ndjson_rows", READING, f"""
SELECT '{{"schema_version":1,"event_id":"' || event_id || '","device_id":"' || device_id || '","event_time":"' || {nano('event_time')}
       || '","received_at":"' || {nano('received_at')} || '"' || coalesce(',"sequence":' || sequence, '') || ',"temperature_c":' || temperature_c
       || ',"vibration_mm_s":' || vibration_mm_s || ',"site_id":"' || site_id || '"}}' AS value FROM reading""")
add("export_json_pages", READING + ",\nnumbered AS (SELECT event_id, row_number() OVER (ORDER BY event_time, event_id) - 1 AS i FROM reading)", """
SELECT CAST(i // 1000 AS BIGINT) AS page, count(*) AS n, arg_min(event_id, i) AS first_id, arg_max(event_id, i) AS last_id FROM numbered GROUP BY 1""")
add("live_frames", ALERTS, f"""
SELECT 'event' AS type, device_id, '{{"type":"event","data":{{"event_id":"' || event_id || '","device_id":"' || device_id || '","event_time":"'
       || {nano('event_time')} || '","temperature_c":' || temperature_c || ',"vibration_mm_s":' || vibration_mm_s || '}}}}' AS payload FROM reading
UNION ALL SELECT 'alert', device_id, '{{"type":"alert","data":{{"alert_id":"' || alert_id || '","device_id":"' || device_id || '","event_id":"' || event_id
       || '","rule":"' || rule || '","threshold":' || threshold || ',"observed":' || observed || ',"event_time":"' || {nano('event_time')} || '"}}}}' FROM fired""")

# --- import of files --------------------------------------------------------
IMPORT = CHECKED + """,
lines AS (SELECT row_number() OVER (ORDER BY row_no) AS line, CASE WHEN broken THEN NULL ELSE device_id END AS device_id, CASE WHEN broken THEN NULL ELSE temperature_c END AS temperature_c,
    CASE WHEN broken THEN NULL ELSE vibration_mm_s END AS vibration_mm_s, CASE WHEN broken THEN NULL ELSE event_time END AS event_time, broken, site_id, sequence FROM record),
read AS (SELECT *, CASE WHEN broken THEN 'invalid_event_id' WHEN temperature_c IS NULL THEN 'malformed_json' WHEN device_id = 'press/01' THEN 'invalid_event_id'
    WHEN event_time IS NULL THEN 'invalid_timestamp' WHEN vibration_mm_s IS NULL THEN 'missing_field'
    WHEN temperature_c > 250 OR vibration_mm_s < 0 THEN 'out_of_range' END AS reason FROM lines)"""
IMPORT_ROWS = "SELECT line AS row_no, coalesce(device_id, '') || '-' || line AS event_id, device_id, temperature_c, vibration_mm_s, reason FROM read"
add("import_csv_rows", IMPORT, IMPORT_ROWS)
add("import_json_array", IMPORT, IMPORT_ROWS)
add("csv_records", IMPORT, """
SELECT line AS row_no, device_id AS machine,
       CASE WHEN NOT broken THEN 'plant "' || coalesce(site_id, '?') || '",' || chr(10) || 'line ' || sequence END AS operator FROM lines""")
add("import_ndjson_summary", IMPORT, f"""
SELECT 'ndjson' AS format, count(*) AS rows, count(DISTINCT device_id) AS devices,
       (SELECT string_agg(c, ',' ORDER BY f, c) FROM (SELECT c, min(line) AS f FROM lines, LATERAL (VALUES ('Machine', NOT broken), ('Temp', NOT broken), ('Timestamp', NOT broken),
         ('Vibration', NOT broken AND vibration_mm_s IS NOT NULL), ('Operator', NOT broken AND sequence IS NOT NULL)) AS v(c, given) WHERE given GROUP BY c)) AS columns,
       'Machine=device_id,Temp=temperature_c,Timestamp=event_time,Vibration=vibration_mm_s' AS mapped, 'Operator' AS ignored,
       'event_id (device id and row number),schema_version (1)' AS derived, {millis('min(event_time)')} AS first_time, {millis('max(event_time)')} AS last_time,
       count(reason) AS problems
FROM read""")

# --- streaming --------------------------------------------------------------
STREAMED = DEDUPED + """,
fresh AS (SELECT *, row_number() OVER (ORDER BY received_at, batch_no, idx) AS arrival FROM deduped WHERE reason IS NULL),
""" + first_wins("fresh", "won", "", "arrival") + """,
stored AS (SELECT f.* FROM fresh f JOIN won w ON w.event_id = f.event_id AND w.o = f.arrival)"""
add("stream_ingest_stored", STREAMED, "SELECT event_id, device_id, sequence, temperature_c, batch_id, CAST(idx AS INTEGER) AS idx FROM stored")
add("stream_alerts", STREAMED + fired("stored"), "SELECT alert_id, rule, observed FROM fired")
add("stream_live_latest", STREAMED, """
SELECT device_id, event_id, temperature_c FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY received_at DESC, batch_id DESC, idx DESC) AS r FROM stored) WHERE r = 1""")
SETTING = """setting AS (SELECT min(ts) AS valid_from, 80.0::DOUBLE + day(any_value(ts)) % 7 AS tl, (70 + day(any_value(ts)) % 3)::DOUBLE / 10.0 AS vl
  FROM events GROUP BY CAST(ts AS DATE))"""
add("stream_thresholds", STREAMED + ",\n" + SETTING + """,
dated AS (SELECT r.*, coalesce(s.tl, 85.0) AS tl, coalesce(s.vl, 7.1) AS vl FROM stored r ASOF LEFT JOIN setting s ON r.received_at >= s.valid_from)""", """
SELECT event_id || ':temperature_high' AS alert_id, CAST(tl AS DOUBLE) AS threshold, temperature_c AS observed FROM dated WHERE temperature_c >= tl
UNION ALL SELECT event_id || ':vibration_high', CAST(vl AS DOUBLE), vibration_mm_s FROM dated WHERE vibration_mm_s >= vl""")
add("stream_frames", STREAMED + fired("stored"), f"""
SELECT 'event' AS type, device_id, '{{"type":"event","data":{{"event_id":"' || event_id || '","device_id":"' || device_id || '","event_time":"'
       || {nano('event_time')} || '","temperature_c":' || temperature_c || ',"vibration_mm_s":' || vibration_mm_s || '}}}}' AS payload FROM stored
UNION ALL SELECT 'alert', device_id, '{{"type":"alert","data":{{"alert_id":"' || alert_id || '","device_id":"' || device_id || '","event_id":"' || event_id
       || '","rule":"' || rule || '","threshold":' || threshold || ',"observed":' || observed || ',"event_time":"' || {nano('event_time')} || '"}}}}' FROM fired""")
add("stream_metrics", STREAMED + fired("stored"), f"""
SELECT 'validation_failures' AS metric, r.reason AS label, count(d.reason) AS n FROM {REASONS} LEFT JOIN deduped d ON d.reason = r.reason GROUP BY r.reason
UNION ALL SELECT 'processed_events', 'stored', count(*) FROM stored
UNION ALL SELECT 'processed_events', 'duplicate', (SELECT count(*) FROM fresh) - (SELECT count(*) FROM stored)
UNION ALL SELECT 'processed_events', 'failed', 0
UNION ALL SELECT 'alerts_created', v.rule, count(f.rule) FROM (VALUES ('temperature_high'), ('vibration_high')) v(rule) LEFT JOIN fired f ON f.rule = v.rule GROUP BY v.rule""")
add("stream_bounded_dedup", GOOD, "SELECT DISTINCT event_id FROM good")
add("stream_per_second", GOOD, f"SELECT {nano('''date_trunc('second', event_time)''')} AS second, count(*) AS n FROM good GROUP BY date_trunc('second', event_time)")

# --- tables on disk, names and failures --------------------------------------
add("lenient_lines", RECORD, "SELECT count(*) FILTER (broken) AS unreadable_lines, count(*) FILTER (NOT broken) AS readable_lines FROM record")
add("stored_day", READING, "SELECT site_id, count(*) AS n, max(temperature_c) AS max_temperature_c FROM reading WHERE CAST(event_time AS DATE) = DATE '2024-01-10' GROUP BY 1")
add("cleared_rows", ALERTS, "SELECT (SELECT count(*) FROM reading) AS deleted_events, (SELECT count(*) FROM fired) AS deleted_alerts, CAST(0 AS BIGINT) AS \"left\"")
add("failure_stages", "", """
SELECT s.stage, count(f.event_id) AS n FROM (VALUES ('persist', 'error', -1), ('alert_persist', 'signup', -1), ('shutdown_drop', 'view', 900)) s(stage, kind, after)
LEFT JOIN events f ON f.event_type = s.kind AND f.event_id > s.after GROUP BY 1""")
add("file_names", SRC, "SELECT 'run-' || (n % 50) || '.csv' AS name, 'Authorization: (hidden)' AS header, count(*) AS n FROM src GROUP BY 1")
