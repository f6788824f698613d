from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse.functions.times import instant
from plantpulse.operators import quality as R
from plantpulse.operators.validate import check_records

BASE = datetime(2025, 1, 15, 8, tzinfo=timezone.utc)
SCHEMA = ("row_no int, schema_version bigint, event_id string, device_id string, event_time string, sequence bigint,"
          "temperature_c double, vibration_mm_s double, site_id string, shape string")


def row(n, device, minute, temp=None, vib=None, event_id=None, time=None, shape=None):
    text = time if time is not None else (BASE + timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")
    temp = 20.0 + n % 7 if temp is None else temp
    return (n, 1, event_id or f"{device}-{n}", device, text, None, temp, 1.0 + n % 3 if vib is None else vib, None, shape)


def table(spark, records):
    return spark.createDataFrame(records, SCHEMA)


def report(spark, records, pieces=None):
    return {r["device"]: r for r in R.device_report(table(spark, records), pieces).collect()}


def sentences(spark, records, derived=False):
    data = table(spark, records)
    checked = check_records(data.withColumn("received_at", instant("2025-02-01T00:00:00Z")))
    devices = R.device_report(data)
    totals = R.report_totals(data, checked, devices, derived)
    return totals.first(), [(r["level"], r["text"]) for r in R.findings(totals, R.rejections_by_reason(checked), devices).orderBy("line_no").collect()], checked


def test_clean_file(spark):
    records = [row(i + 1, "a", i, temp=20.0 + i % 7) for i in range(30)]
    totals, lines, _ = sentences(spark, records)
    assert [level for level, _ in lines] == ["ok"] and totals["rejected"] == 0
    device = report(spark, records)["a"]
    assert (device["usual_interval_seconds"], device["longest_gap_seconds"], device["gaps"]) == (60.0, 0.0, 0)
    stats = {r["field"]: r for r in R.value_stats(table(spark, records)).collect()}
    assert (stats["temperature_c"]["min_value"], stats["temperature_c"]["max_value"], stats["temperature_c"]["n"]) == (20.0, 26.0, 30)


def test_rejected_rows_are_counted_with_three_examples(spark):
    records = [row(i + 1, "a", i, temp=999.0 if i < 12 else None) for i in range(30)]
    totals, lines, checked = sentences(spark, records)
    examples = R.rejection_examples(checked).orderBy("example").collect()
    assert [(r["row"], r["n"]) for r in examples] == [(1, 12), (2, 12), (3, 12)]
    assert lines[0] == ("problem", "12 of 30 rows (40.0%) would be rejected by the schema checks: 12 value out of range.")


@pytest.mark.parametrize("pieces", [None, 8])
def test_disorder_gap_and_stuck_sensor(spark, pieces):
    records = [row(i + 1, "a", i) for i in range(20)]
    records += [row(21, "a", 5), row(22, "a", 120)]
    records += [row(23 + i, "b", i, temp=50.0) for i in range(15)]
    got = report(spark, records, pieces)
    a, b = got["a"], got["b"]
    assert (a["rows"], a["out_of_order"], a["gaps"], a["longest_gap_seconds"], a["usual_interval_seconds"]) == (22, 1, 1, 101 * 60.0, 60.0)
    assert (b["stuck_runs"], b["gaps"], b["out_of_order"]) == (1, 0, 0)
    assert rows(R.duplicate_readings(table(spark, records)), "device_id", "duplicate_readings") == [("a", 1), ("b", 0)]


def plain_report(records):
    """The report told device by device, over lists."""
    out = []
    for device in {r[3] for r in records}:
        own = [r for r in records if r[3] == device]
        at = lambda r: None if r[4] == "bad" else datetime.strptime(r[4], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp()
        late, latest = 0, None
        for r in own:
            if at(r) is not None:
                late += latest is not None and at(r) < latest
                latest = at(r) if latest is None else max(latest, at(r))
        timed = sorted((at(r), r[0], r[6], r[7]) for r in own if at(r) is not None)
        steps = sorted(b[0] - a[0] for a, b in zip(timed, timed[1:]) if b[0] > a[0])  # noqa: B905
        usual = steps[len(steps) // 2] if len(steps) >= R.S.MIN_INTERVALS_FOR_GAP else 0.0
        silent = [s for s in steps if usual and s > usual * R.S.GAP_FACTOR]
        stuck = 0
        for column in (2, 3):
            length, before = 0, None
            for r in timed:
                value = r[column] if r[column] == r[column] else None
                length = length + 1 if value is not None and value == before else 1
                stuck += value is not None and length == R.S.STUCK_RUN_LENGTH
                before = value
        shown = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        out.append((device, len(own), shown(timed[0][0]), shown(timed[-1][0]), usual, max(silent, default=0.0), len(silent), late, stuck))
    return sorted(out, key=repr)


def test_cut_groups_give_the_same_report(spark):
    import random

    rng = random.Random(11)
    records = []
    for n in range(1, 501):
        device = "hot" if rng.random() < 0.6 else f"d{rng.randrange(3)}"
        minute = n + rng.choice([0, 0, 0, -3, 40]) if rng.random() < 0.9 else n
        records.append(row(n, device, minute, temp=rng.choice([1.0, 1.0, 1.0, 1.0, 2.0, float("nan")]), vib=3.0, time="bad" if rng.random() < 0.05 else None))
    columns = ["device", "rows", "first_time", "last_time", "usual_interval_seconds", "longest_gap_seconds", "gaps", "out_of_order", "stuck_runs"]
    data = table(spark, records).cache()
    whole = rows(R.device_report(data), *columns)
    assert whole == rows(R.device_report(data, 25, block=7), *columns)
    assert whole == plain_report(records)
    assert sum(r[-1] for r in whole) > 0 and sum(r[-2] for r in whole) > 0 and sum(r[-3] for r in whole) > 0


def test_repeated_ids_count_only_when_the_file_has_ids(spark):
    records = [row(1, "a", 0, event_id="x"), row(2, "a", 1, event_id="x")]
    assert R.duplicate_ids(table(spark, records)).first()[0] == 1
    assert R.duplicate_ids(table(spark, records), derived_ids=True).first()[0] == 0


def test_twenty_of_thirty_devices(spark):
    records = [row(i + 1, f"d{i:02d}", 0) for i in range(30)]
    devices = R.device_report(table(spark, records))
    assert devices.count() == 30 and [r["device"] for r in R.worst_devices(devices).collect()] == [f"d{i:02d}" for i in range(20)]


def test_words(spark):
    from plantpulse.functions.text import human_seconds, reason_label

    texts = spark.createDataFrame([(89.4,), (90.0,), (5399.0,), (5400.0,)], "s double").select(human_seconds(F.col("s")).alias("t"))
    assert [r["t"] for r in texts.collect()] == ["89 s", "1.5 min", "90.0 min", "1.5 h"]
    labels = spark.createDataFrame([("out_of_range",), ("some_thing",)], "r string").select(reason_label(F.col("r")).alias("t"))
    assert [r["t"] for r in labels.collect()] == ["value out of range", "(some thing)"]
