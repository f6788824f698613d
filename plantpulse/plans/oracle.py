"""The same results in plain SQL over the driver tables, for comparison with the registered queries."""

from __future__ import annotations

# --- views ------------------------------------------------------------------
SRC = """src AS (
  SELECT event_id AS n,
         'ev-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
         'dev-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS device_id,
         user_id, ts AS t,
         CASE WHEN event_id % 10 <> 0 THEN event_id END AS sequence,
         value AS temperature_c,
         CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS DOUBLE) / 10.0 AS vibration_mm_s,
         event_type AS site_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         event_id // 500 AS batch_no, event_id % 500 AS idx
  FROM events)"""

READING = SRC + """,
reading AS (
  SELECT n, event_id, device_id, site_id, 1 AS schema_version, t AS event_time,
         t + to_microseconds(k * 50000) AS received_at, sequence, temperature_c, vibration_mm_s,
         CAST(batch_no AS VARCHAR) AS batch_id, idx
  FROM src)"""

BASE = SRC + """,
base AS (
  SELECT n, event_id, device_id, t, sequence, vibration_mm_s, site_id, batch_no, idx,
         CASE WHEN user_id % 15 = 0 AND day(t) BETWEEN 5 AND 16 THEN 50.0 ELSE temperature_c END AS temperature_c,
         CASE WHEN n % 47 < 14 THEN n % 47 END AS kind,
         t + to_microseconds(k * 50000) AS received_at
  FROM src),
timed AS (
  SELECT * REPLACE (CASE WHEN kind = 8 THEN t + INTERVAL 1 HOUR
                         WHEN kind IS NULL AND n % 30 = 7 THEN t - INTERVAL 1 HOUR ELSE t END AS t)
  FROM base),
dirty AS (
  SELECT n, 0 AS copy_no, event_id, device_id, sequence, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx FROM timed
  UNION ALL SELECT n, 1, event_id, device_id, sequence, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no + 1, idx + 1000 FROM timed WHERE kind IS NULL AND n % 40 = 3
  UNION ALL SELECT n, 2, 'alt-' || n, device_id, sequence, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx + 1500 FROM timed WHERE kind IS NULL AND n % 55 = 4
  UNION ALL SELECT n, 3, event_id, device_id, sequence, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx + 2000 FROM timed WHERE kind IS NULL AND n % 70 = 5
  UNION ALL SELECT n, 4, 'chain-' || n, device_id, sequence, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx + 3000 FROM timed WHERE kind IS NULL AND n % 60 = 11
  UNION ALL SELECT n, 5, 'chain-' || n, device_id, n + 10000000, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx + 4000 FROM timed WHERE kind IS NULL AND n % 60 = 11
  UNION ALL SELECT n, 6, 'tail-' || n, device_id, n + 10000000, temperature_c, vibration_mm_s, site_id, t, kind, received_at,
         batch_no, idx + 5000 FROM timed WHERE kind IS NULL AND n % 60 = 11)"""

# The records as they arrive: each fault changes one column.
RECORD = BASE + """,
record AS (
  SELECT n * 10 + copy_no + 1 AS row_no, batch_no, CAST(batch_no AS VARCHAR) AS batch_id, idx, received_at,
         kind IS NOT DISTINCT FROM 11 AS broken,
         kind IS NOT DISTINCT FROM 6 AS extra,
         kind IS NOT DISTINCT FROM 1 AS hot,
         CASE WHEN kind = 4 THEN 99 ELSE 1 END AS schema_version,
         CASE WHEN kind = 5 THEN 'bad id!' ELSE event_id END AS event_id,
         CASE WHEN kind = 9 THEN 'press/01' ELSE device_id END AS device_id,
         CASE WHEN kind = 3 THEN 'not-a-timestamp' ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') END AS time_text,
         CASE WHEN kind = 3 THEN NULL ELSE t END AS event_time,
         CASE WHEN kind = 7 THEN -1 ELSE sequence END AS sequence,
         CASE WHEN kind IN (0, 1) THEN NULL WHEN kind = 2 THEN 9999.0 ELSE temperature_c END AS temperature_c,
         CASE WHEN kind = 13 THEN NULL WHEN kind = 12 THEN -1.0 ELSE vibration_mm_s END AS vibration_mm_s,
         CASE WHEN kind = 10 THEN 'plant a' ELSE site_id END AS site_id
  FROM dirty)"""

ID = "[A-Za-z0-9][A-Za-z0-9._:-]{0,63}"
CHECKED = RECORD + f""",
judged AS (
  SELECT *, CASE
    WHEN broken THEN 'malformed_json|record is not a valid JSON object of the expected shape'
    WHEN extra THEN 'unknown_field|record contains a field that is not part of schema v1'
    WHEN hot THEN 'malformed_json|field "temperature_c" has the wrong JSON type'
    WHEN schema_version <> 1 THEN 'unsupported_schema_version|schema_version must be 1'
    WHEN NOT regexp_full_match(event_id, '{ID}') THEN 'invalid_event_id|event_id must match {ID}'
    WHEN NOT regexp_full_match(device_id, '{ID}') THEN 'invalid_device_id|device_id must match {ID}'
    WHEN event_time IS NULL THEN 'invalid_timestamp|event_time must be an RFC 3339 timestamp'
    WHEN event_time > received_at + INTERVAL 5 MINUTE
      THEN 'time_in_future|event_time is further in the future than the allowed clock skew'
    WHEN temperature_c IS NULL THEN 'missing_field|temperature_c is required'
    WHEN vibration_mm_s IS NULL THEN 'missing_field|vibration_mm_s is required'
    WHEN temperature_c < -50 OR temperature_c > 250 THEN 'out_of_range|temperature_c must be finite and within [-50, 250]'
    WHEN vibration_mm_s < 0 OR vibration_mm_s > 100 THEN 'out_of_range|vibration_mm_s must be finite and within [0, 100]'
    WHEN sequence < 0 THEN 'invalid_sequence|sequence must be >= 0'
    WHEN NOT regexp_full_match(site_id, '{ID}') THEN 'invalid_site_id|site_id must match {ID}'
    END AS verdict
  FROM record),
checked AS (
  SELECT * EXCLUDE (verdict), split_part(verdict, '|', 1) AS reason, substr(verdict, strpos(verdict, '|') + 1) AS detail
  FROM judged)"""


def first_wins(rows: str, out: str, scope: str, order: str, rounds: int = 3) -> str:
    """Rounds of: accept what is first under both keys, drop its neighbours. `out` lists the accepted rows."""
    scope = f"{scope}, " if scope else ""
    parts = [f"{out}_u0 AS MATERIALIZED (SELECT {scope}event_id, device_id, sequence, {order} AS o FROM {rows})"]
    on = lambda a, b: (f"{a}.{scope[:-2]} = {b}.{scope[:-2]} AND " if scope else "")
    for i in range(rounds):
        u, a = f"{out}_u{i}", f"{out}_a{i}"
        parts.append(
            f"{a} AS MATERIALIZED (SELECT * EXCLUDE (mi, ms) FROM (SELECT *, min(o) OVER (PARTITION BY {scope}event_id) AS mi,"
            f" CASE WHEN sequence IS NOT NULL THEN min(o) OVER (PARTITION BY {scope}device_id, sequence) END AS ms FROM {u})"
            f" WHERE o = mi AND (sequence IS NULL OR o = ms))"
        )
        parts.append(
            f"{out}_u{i + 1} AS MATERIALIZED (SELECT * FROM {u} WHERE"
            f" NOT EXISTS (SELECT 1 FROM {a} x WHERE {on('x', u)}x.event_id = {u}.event_id)"
            f" AND NOT EXISTS (SELECT 1 FROM {a} x WHERE {on('x', u)}x.device_id = {u}.device_id AND x.sequence = {u}.sequence))"
        )
    union = " UNION ALL ".join(f"SELECT * FROM {out}_a{i}" for i in range(rounds))
    parts.append(f"{out} AS MATERIALIZED ({union})")
    return ",\n".join(parts)


GOOD = CHECKED + ",\ngood AS (SELECT * FROM checked WHERE reason IS NULL)"
DEDUPED = (
    GOOD
    + ",\n"
    + first_wins("good", "kept", "batch_id", "idx")
    + """,
deduped AS (
  SELECT g.* REPLACE (
      CASE WHEN k.o = g.idx THEN NULL ELSE 'duplicate_in_batch' END AS reason,
      CASE WHEN k.o = g.idx THEN NULL
           WHEN k.o < g.idx THEN 'event_id already appears earlier in this batch'
           ELSE 'device_id and sequence already appear earlier in this batch' END AS detail)
  FROM good g LEFT JOIN kept k ON k.batch_id = g.batch_id AND k.event_id = g.event_id
  UNION ALL SELECT * FROM checked WHERE reason IS NOT NULL)"""
)
OUTCOMES = (
    DEDUPED
    + """,
old AS (SELECT event_id, device_id, sequence FROM src WHERE site_id IN ('click', 'view')),
arriving AS (
  SELECT d.batch_id, d.batch_no, d.idx, d.event_id, d.device_id, d.sequence, d.temperature_c, d.vibration_mm_s, d.event_time,
         d.received_at,
         EXISTS (SELECT 1 FROM old WHERE old.event_id = d.event_id) OR
         EXISTS (SELECT 1 FROM old WHERE old.device_id = d.device_id AND old.sequence = d.sequence) AS known
  FROM deduped d WHERE d.reason IS NULL),
fresh AS (SELECT * FROM arriving WHERE NOT known),
"""
    + first_wins("fresh", "won", "", "batch_no * 100000 + idx")
    + """,
outcomes AS (
  SELECT a.*, CASE WHEN NOT a.known AND w.o = a.batch_no * 100000 + a.idx THEN 'stored' ELSE 'duplicate' END AS outcome
  FROM arriving a LEFT JOIN won w ON w.event_id = a.event_id)"""
)

REASONS = """(VALUES ('malformed_json'), ('unknown_field'), ('unsupported_schema_version'), ('missing_field'),
  ('invalid_event_id'), ('invalid_device_id'), ('invalid_site_id'), ('invalid_timestamp'), ('time_in_future'),
  ('invalid_sequence'), ('out_of_range'), ('duplicate_in_batch')) r(reason)"""

LABELS = """CASE reason WHEN 'malformed_json' THEN 'value of the wrong type or unreadable' WHEN 'unknown_field' THEN 'unknown field'
  WHEN 'unsupported_schema_version' THEN 'unsupported schema version' WHEN 'missing_field' THEN 'missing value'
  WHEN 'invalid_event_id' THEN 'invalid event id' WHEN 'invalid_device_id' THEN 'invalid device id'
  WHEN 'invalid_site_id' THEN 'invalid site id' WHEN 'invalid_timestamp' THEN 'invalid time'
  WHEN 'time_in_future' THEN 'time in the future' WHEN 'invalid_sequence' THEN 'invalid sequence number'
  WHEN 'out_of_range' THEN 'value out of range' ELSE 'repeated within one batch' END"""


def nano(c: str) -> str:
    return f"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"


def millis(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def number(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def fired(rows: str, created: str = "received_at") -> str:
    """Alerts of the readings in `rows`."""
    return ",\nfired AS (" + " UNION ALL ".join(
        f"SELECT event_id || ':{rule}' AS alert_id, device_id, event_id, '{rule}' AS rule, CAST({limit} AS DOUBLE) AS threshold,"
        f" {value} AS observed, event_time, {created} AS created_at FROM {rows} WHERE {value} >= {limit}"
        for rule, value, limit in (("temperature_high", "temperature_c", "85.0"), ("vibration_high", "vibration_mm_s", "7.1"))
    ) + ")"


ALERTS = READING + fired("reading")

# --- data-quality report ----------------------------------------------------
ROWS = """,
rows AS (
  SELECT row_no, event_id, device_id, time_text, CASE WHEN NOT broken THEN event_time END AS t, temperature_c, vibration_mm_s
  FROM record WHERE NOT broken)"""
IMPORTED = RECORD + ROWS


def with_silence(text: str) -> str:
    """The same without the readings of every 25th device for a week."""
    return text.replace("\n  FROM src),\ntimed", "\n  FROM src WHERE NOT (user_id % 25 = 0 AND day(t) BETWEEN 18 AND 24)),\ntimed")


REPORT = with_silence(RECORD) + ROWS + """,
late AS (
  SELECT device_id, count(*) AS n FROM (
    SELECT device_id, t, max(t) OVER (PARTITION BY device_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
    FROM rows) WHERE t < m GROUP BY 1),
steps AS (
  SELECT device_id, s FROM (
    SELECT device_id, epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY device_id ORDER BY t, row_no)) AS s
    FROM rows WHERE t IS NOT NULL) WHERE s > 0),
usual AS (
  SELECT device_id, s AS u FROM (
    SELECT device_id, s, row_number() OVER (PARTITION BY device_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n
    FROM steps) WHERE n >= 5 AND i = n // 2),
gap AS (
  SELECT device_id, count(*) AS n, max(s) AS longest FROM steps JOIN usual USING (device_id) WHERE s > 3 * u GROUP BY 1),
series AS (
  SELECT device_id, t, row_no, 1 AS f, temperature_c AS v FROM rows WHERE t IS NOT NULL
  UNION ALL SELECT device_id, t, row_no, 2, vibration_mm_s FROM rows WHERE t IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND v IS NOT NULL THEN 0 ELSE 1 END AS c
  FROM series WINDOW w AS (PARTITION BY device_id, f ORDER BY t, row_no)),
islands AS (
  SELECT device_id, f, v, sum(c) OVER (PARTITION BY device_id, f ORDER BY t, row_no ROWS UNBOUNDED PRECEDING) AS g FROM marked),
stuck AS (
  SELECT device_id, count(*) AS n FROM (
    SELECT device_id, f, g FROM islands WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1),
report AS (
  SELECT d.device_id AS device, d.n AS "rows", """ + millis("d.a") + ' AS first_time, ' + millis("d.z") + """ AS last_time,
         coalesce(u.u / 1000000.0, 0.0) AS usual_interval_seconds, coalesce(g.longest / 1000000.0, 0.0) AS longest_gap_seconds,
         CAST(coalesce(g.n, 0) AS BIGINT) AS gaps, CAST(coalesce(l.n, 0) AS BIGINT) AS out_of_order,
         CAST(coalesce(s.n, 0) AS BIGINT) AS stuck_runs
  FROM (SELECT device_id, count(*) AS n, min(t) AS a, max(t) AS z FROM rows GROUP BY 1) d
  LEFT JOIN usual u USING (device_id) LEFT JOIN gap g USING (device_id) LEFT JOIN late l USING (device_id)
  LEFT JOIN stuck s USING (device_id)),
listed AS (SELECT * FROM report ORDER BY gaps + out_of_order + stuck_runs DESC, device LIMIT 20)"""

REPORT_TOTALS = with_silence(CHECKED) + REPORT[len(with_silence(RECORD)):] + """,
totals AS (
  SELECT (SELECT count(*) FROM checked) AS "rows", (SELECT count(*) FROM checked WHERE reason IS NOT NULL) AS rejected,
         (SELECT CAST(count(*) - count(DISTINCT event_id) AS BIGINT) FROM rows) AS duplicate_ids,
         (SELECT CAST(count(*) - count(DISTINCT device_id || chr(0) || time_text) AS BIGINT) FROM rows) AS duplicate_readings,
         (SELECT CAST(sum(out_of_order) AS BIGINT) FROM report) AS out_of_order,
         (SELECT CAST(sum(gaps) AS BIGINT) FROM report) AS gaps, (SELECT CAST(sum(stuck_runs) AS BIGINT) FROM report) AS stuck_runs,
         (SELECT count(*) FROM report) AS devices_total)"""

# --- delivery log -----------------------------------------------------------
LOG = """own AS (
  SELECT event_id AS n, event_id // 2 AS pair, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL WHEN event_type = 'error' THEN 500
              WHEN event_type = 'signup' THEN 429 WHEN event_type = 'view' THEN 503 ELSE 202 END AS status FROM events),
paired AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n) - 1 AS pos,
         coalesce(first_value(status) OVER (PARTITION BY pair ORDER BY n) IN (429, 503), false)
           AND count(*) OVER (PARTITION BY pair) = 2 AS retry FROM own),
attempt0 AS (
  SELECT 'run-' || lpad(CAST(n // 2500 AS VARCHAR), 5, '0') AS run_id, n // 2500 AS run_no, n,
         CASE WHEN retry THEN pair * 2 ELSE n END % 2500 AS batch_no, CASE WHEN retry THEN pos ELSE 0 END AS attempt_no,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(n // 2500) + to_seconds((n % 2500) // 10)
           + to_microseconds((n % 10) * 97000) AS finished_at,
         round(value * 1000) / 1000000.0 AS latency, 1 + pair % 50 AS n_records, status, k,
         (n // 2500) % 2 = 1 AS outside, pair % 4 <> 0 AS is_ack,
         least(1 + pair % 50, pair % 3) AS rej, retry AND pos = 0 AS will_retry FROM paired),
attempt AS (
  SELECT *, CASE WHEN is_ack AND status = 202 THEN n_records - rej ELSE 0 END AS aa,
         CASE WHEN is_ack AND status IN (202, 429, 503) THEN rej ELSE 0 END AS ar,
         CASE WHEN status IS NULL THEN 'error' WHEN status = 202 THEN 'ok' WHEN status IN (429, 503) THEN 'throttled'
              ELSE 'error' END AS kind FROM attempt0),
judged AS (
  SELECT *, kind = 'ok' AND (NOT outside OR (is_ack AND aa + ar = n_records)) AS own_words,
         kind = 'throttled' AND NOT will_retry AS refused FROM attempt),
outcome AS (
  SELECT *, CASE WHEN own_words THEN aa WHEN kind = 'ok' THEN n_records ELSE 0 END AS accepted,
         CASE WHEN own_words OR refused THEN ar ELSE 0 END AS rejected,
         CASE WHEN refused THEN greatest(0, n_records - ar) ELSE 0 END AS gave_up,
         CASE WHEN kind = 'error' THEN n_records ELSE 0 END AS errored FROM judged)"""

TOTALS = LOG + """,
run AS (
  SELECT run_id, any_value(run_no) AS run_no, bool_or(outside) AS outside,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(any_value(run_no)) AS started_at,
         (epoch_us(max(finished_at)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_hours(any_value(run_no)))) / 1000000.0 AS elapsed_s,
         sum(CASE WHEN attempt_no = 0 THEN n_records ELSE 0 END) AS planned, count(*) FILTER (attempt_no = 0) AS batches
  FROM attempt GROUP BY run_id),
total AS (
  SELECT run_id, count(*) FILTER (NOT will_retry) AS batches_done,
         sum(CASE WHEN NOT will_retry THEN n_records ELSE 0 END) AS records_done, sum(accepted) AS accepted, sum(rejected) AS rejected,
         count(*) FILTER (status = 429) AS throttled, count(*) FILTER (will_retry) AS retries, sum(gave_up) AS gave_up_records,
         count(*) FILTER (kind = 'error') AS request_errors, sum(errored) AS errored_records
  FROM outcome GROUP BY run_id),
latency AS MATERIALIZED (
  SELECT run_id, any_value(n) AS count,
         round(max(l) FILTER (i = greatest(1, ceil(0.5::DOUBLE * n))) * 1000, 3) AS p50_ms,
         round(max(l) FILTER (i = greatest(1, ceil(0.95::DOUBLE * n))) * 1000, 3) AS p95_ms,
         round(max(l) FILTER (i = greatest(1, ceil(0.99::DOUBLE * n))) * 1000, 3) AS p99_ms,
         round(max(l) * 1000, 3) AS max_ms, round(avg(l) * 1000, 3) AS mean_ms
  FROM (SELECT run_id, latency AS l, row_number() OVER (PARTITION BY run_id ORDER BY latency) AS i,
               count(*) OVER (PARTITION BY run_id) AS n FROM attempt) GROUP BY run_id),
ticks AS (
  SELECT run_id, (epoch_us(finished_at) - epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_hours(run_no))) // 1000000 AS t, * EXCLUDE (run_id)
  FROM attempt),
second AS (
  SELECT run_id, t, count(*) AS requests, sum(n_records) AS sent, sum(CASE WHEN kind = 'ok' THEN n_records ELSE 0 END) AS records,
         count(*) FILTER (kind = 'throttled') AS throttled, count(*) FILTER (kind = 'error') AS errors
  FROM ticks GROUP BY 1, 2),
mark AS (
  SELECT run_id, t, floor(max(l) FILTER (i = (n - 1) // 2) * 10000 + 0.5) / 10 AS p50_ms,
         floor(max(l) FILTER (i = floor((n - 1) * 0.95::DOUBLE)) * 10000 + 0.5) / 10 AS p95_ms
  FROM (SELECT run_id, t, latency AS l, row_number() OVER (PARTITION BY run_id, t ORDER BY latency) - 1 AS i,
               count(*) OVER (PARTITION BY run_id, t) AS n FROM ticks) GROUP BY 1, 2),
dense AS (SELECT run_id, unnest(generate_series(0, m)) AS t FROM (SELECT run_id, max(t) AS m FROM second GROUP BY 1)),
point AS (
  SELECT d.run_id, CAST(d.t AS INTEGER) AS t, CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(sent, 0) AS BIGINT) AS sent,
         CAST(coalesce(records, 0) AS BIGINT) AS records, CAST(coalesce(throttled, 0) AS BIGINT) AS throttled,
         CAST(coalesce(errors, 0) AS BIGINT) AS errors, coalesce(p50_ms, 0.0) AS p50_ms, coalesce(p95_ms, 0.0) AS p95_ms
  FROM dense d LEFT JOIN second s ON s.run_id = d.run_id AND s.t = d.t LEFT JOIN mark m ON m.run_id = d.run_id AND m.t = d.t),
busy AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) AS a, row_number() OVER (PARTITION BY run_id ORDER BY t DESC) AS z
  FROM point WHERE requests > 0),
summary AS MATERIALIZED (
  SELECT p.run_id, max(p.sent) AS peak_sent_per_s, max(p.records) AS peak_accepted_per_s,
         min(p.t) FILTER (p.throttled > 0) AS first_throttled_at_s, arg_min(p.sent, p.t) FILTER (p.throttled > 0) AS sent_per_s_at_first_throttle,
         min(p.t) FILTER (p.errors > 0) AS first_error_at_s, arg_min(p.sent, p.t) FILTER (p.errors > 0) AS sent_per_s_at_first_error,
         max(b.p95_ms) FILTER (b.a <= 3) AS p95_first_ms, max(b.p95_ms) FILTER (b.z <= 3) AS p95_last_ms
  FROM point p LEFT JOIN busy b ON b.run_id = p.run_id AND b.t = p.t GROUP BY p.run_id),
broke AS (
  SELECT run_id, arg_min(batch_no + 1, finished_at) AS batch, arg_min(coalesce(status, -1), finished_at) AS status0,
         arg_min(k, finished_at) AS k FROM attempt WHERE kind = 'error' GROUP BY 1),
first_bad AS (
  SELECT run_id, batch, nullif(status0, -1) AS status,
         CASE WHEN status0 = -1 THEN 'connection refused' ELSE 'the service answered 500 Internal Server Error' END AS message,
         CASE WHEN status0 = 500 THEN 'upstream ' || k || ' failed' END AS body FROM broke)"""

SHORT_PACE = "'as fast as possible, batches of 50, 8 connections'"
FIRST_429 = "CASE WHEN {0}.first_throttled_at_s IS NULL THEN 'none' ELSE 'at ' || {0}.first_throttled_at_s || ' s (' || {0}.sent_per_s_at_first_throttle || '/s)' END"
COMPARED_TEXTS = {
    "Started": "strftime({0}.started_at, '%Y-%m-%d %H:%M:%S')", "Sent to": "'http://host-' || {0}.run_no || ':8080'", "Data": "'generated data'",
    "Pace": SHORT_PACE, "First 429": FIRST_429,
}
COMPARED_ROWS = [
    ("Started", "", "", ""), ("Sent to", "", "", ""), ("Data", "", "", ""), ("Pace", "", "", ""),
    ("Records sent", "records_done", "", ""), ("Accepted", "accepted", "", "higher"), ("Peak sent per second", "peak_sent_per_s", "", ""),
    ("Peak accepted per second", "peak_accepted_per_s", "", "higher"), ("Requests told to slow down (429)", "throttled", "", "lower"),
    ("First 429", "", "", ""), ("Request errors", "request_errors", "", "lower"), ("Latency p95", "p95_ms", " ms", "lower"),
    ("Latency p99", "p99_ms", " ms", "lower"), ("Latency max", "max_ms", " ms", "lower"), ("Took", "elapsed_s", " s", ""),
]


def _compared_row(no: int, label: str, column: str, unit: str, better: str) -> str:
    """A line of the comparison of the facts `fa` and `fb`, as a struct."""
    if column:
        value = {side: f"CAST({side}.{column} AS DOUBLE)" for side in ("fa", "fb")}
        shown = {side: f"{number(v)} || '{unit}'" for side, v in value.items()}
    else:
        value = dict.fromkeys(("fa", "fb"), "CAST(NULL AS DOUBLE)")
        shown = {side: COMPARED_TEXTS[label].format(side) for side in value}
    return (f"{{'no': {no}, 'measure': '{label}', 'a': {value['fa']}, 'b': {value['fb']}, 'shown_a': {shown['fa']}, 'shown_b': {shown['fb']},"
            f" 'unit': '{unit}', 'better': '{better}'}}")


COMPARED = (
    TOTALS
    + ",\nfacts AS MATERIALIZED (SELECT r.run_id, r.run_no, r.started_at, round(r.elapsed_s, 1) AS elapsed_s, t.* EXCLUDE (run_id), l.* EXCLUDE (run_id), s.* EXCLUDE (run_id)"
    + " FROM run r JOIN total t USING (run_id) JOIN latency l USING (run_id) JOIN summary s USING (run_id)),"
    + "\npairs AS MATERIALIZED (SELECT * FROM (SELECT lag(run_id) OVER (ORDER BY started_at) AS run_a, run_id AS run_b FROM facts) WHERE run_a IS NOT NULL),"
    + "\nsides AS (SELECT run_a, run_b, unnest([" + ", ".join(_compared_row(i, *row) for i, row in enumerate(COMPARED_ROWS, 1))
    + "], recursive := true) FROM pairs p JOIN facts fa ON fa.run_id = p.run_a JOIN facts fb ON fb.run_id = p.run_b)"
)


def histogram_sql(rows: str, value: str, bounds: list[float], by: str = "") -> str:
    """Cumulative counts per bound of `value` in the table expression `rows`."""
    key = f"{by}, " if by else ""
    labels = ", ".join(f"({i}, {number(repr(b) + '::DOUBLE')}, {b!r}::DOUBLE)" for i, b in enumerate(bounds))
    labels += f", ({len(bounds)}, '+Inf', 'Infinity'::DOUBLE)"
    return (
        f"SELECT {key}CAST(bucket AS INTEGER) AS bucket, le, CAST(count(*) FILTER ({value} <= ub) AS BIGINT) AS cumulative,"
        f" count(*) AS count, sum({value}) AS total FROM {rows} CROSS JOIN (VALUES {labels}) b(bucket, le, ub) GROUP BY {key}bucket, le"
    )
