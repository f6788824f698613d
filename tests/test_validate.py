import json

from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.times import instant
from plantpulse.operators import validate as V

NOW = "2025-01-15T09:00:00Z"
GOOD = {
    "schema_version": 1, "event_id": "e1", "device_id": "d1", "event_time": "2025-01-15T08:00:00Z",
    "sequence": 5, "temperature_c": 20.5, "vibration_mm_s": 1.5, "site_id": "plant-a",
}


def changed(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not ...})


CASES = [
    (changed(schema_version=...), "missing_field"),
    (changed(event_id=...), "missing_field"),
    (changed(device_id=...), "missing_field"),
    (changed(event_time=...), "missing_field"),
    (changed(temperature_c=...), "missing_field"),
    (changed(vibration_mm_s=...), "missing_field"),
    (changed(temperature_c=None), "missing_field"),
    ("null", "missing_field"),
    ("{}", "missing_field"),
    (changed(schema_version=2), "unsupported_schema_version"),
    (changed(event_id=""), "invalid_event_id"),
    (changed(event_id="a b"), "invalid_event_id"),
    (changed(event_id="x" * 65), "invalid_event_id"),
    (changed(event_id="-x"), "invalid_event_id"),
    (changed(event_id="a\n"), "invalid_event_id"),
    (changed(device_id="press/01"), "invalid_device_id"),
    (changed(site_id="plant a"), "invalid_site_id"),
    (changed(site_id=""), "invalid_site_id"),
    (changed(event_time="2025-01-15 08:00:00"), "invalid_timestamp"),
    (changed(event_time="2025-01-15"), "invalid_timestamp"),
    (changed(event_time="2025-02-30T08:00:00Z"), "invalid_timestamp"),
    (changed(event_time="yesterday"), "invalid_timestamp"),
    (changed(event_time="1969-12-31T23:59:59Z"), "invalid_timestamp"),
    (changed(event_time="2025-01-15T09:06:00Z"), "time_in_future"),
    (changed(event_time="2025-01-15T09:05:00Z"), None),
    (changed(temperature_c=-50.01), "out_of_range"),
    (changed(temperature_c=250.01), "out_of_range"),
    (changed(vibration_mm_s=-0.01), "out_of_range"),
    (changed(vibration_mm_s=100.01), "out_of_range"),
    (changed(temperature_c=-50, vibration_mm_s=0), None),
    (changed(temperature_c=250, vibration_mm_s=100), None),
    (changed(temperature_c=85, vibration_mm_s=7.1), None),
    (changed(sequence=-1), "invalid_sequence"),
    (changed(sequence=...), None),
    (changed(site_id=...), None),
    (changed(sequence=1.5), "malformed_json"),
    (changed(schema_version=1.0).replace("1.0,", "1.0,"), "malformed_json"),
    (changed(temperature_c="hot"), "malformed_json"),
    (changed(device_id=7), "malformed_json"),
    (changed(temperature_c=True), "malformed_json"),
    (changed(temperature_c="@").replace('"@"', "1e999"), "malformed_json"),
    (changed(received_at="x"), "unknown_field"),
    (changed(Event_ID="x"), "unknown_field"),
    ("[1,2]", "malformed_json"),
    ('"text"', "malformed_json"),
    ("42", "malformed_json"),
    ("{", "malformed_json"),
    ("", "malformed_json"),
    (changed(), None),
    ("x" * 3, "malformed_json"),
]


def checked(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx int, raw string")
    return V.validate(df.withColumn("received_at", instant(NOW)), **kw)


def test_first_failing_rule_decides(spark):
    got = {r["idx"]: r["reason"] for r in checked(spark, [t for t, _ in CASES]).collect()}
    wrong = [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][1]]
    assert not wrong


def test_first_offender_follows_document_order(spark):
    texts = [
        '{"extra":1,"temperature_c":"hot"}',
        '{"temperature_c":"hot","extra":1}',
        '{"sequence":1.5,"temperature_c":"hot"}',
    ]
    got = [(r["reason"], r["detail"]) for r in checked(spark, texts).orderBy("idx").collect()]
    assert got == [
        ("unknown_field", S.DETAIL_UNKNOWN),
        ("malformed_json", 'field "temperature_c" has the wrong JSON type'),
        ("malformed_json", 'field "sequence" has the wrong JSON type'),
    ]


def test_times_are_utc_and_cut_to_microseconds(spark):
    df = checked(spark, [changed(event_time="2025-01-15T10:00:00.123456789+02:00")])
    assert df.select(F.unix_micros("event_time")).first()[0] == 1736928000123456


def test_large_sequence_survives(spark):
    df = checked(spark, [changed(sequence=9007199254740993)])
    assert df.first()["sequence"] == 9007199254740993


def test_detail_never_repeats_the_payload(spark):
    texts = [t.replace("hot", "SECRET").replace("a b", "SECRET") for t, _ in CASES]
    details = [r["detail"] or "" for r in checked(spark, texts).collect()]
    assert not [d for d in details if "SECRET" in d]


def test_typed_rows_need_no_text(spark):
    typed = spark.createDataFrame(
        [(1, "e", "d", "2025-01-15T08:00:00Z", 1, t, 1.0, None) for t in (20.0, float("nan"), float("inf"))],
        "schema_version bigint, event_id string, device_id string, event_time string, sequence bigint,"
        "temperature_c double, vibration_mm_s double, site_id string",
    ).withColumn("received_at", instant(NOW))
    assert [r["reason"] for r in V.check_records(typed).collect()] == [None, "out_of_range", "out_of_range"]


def test_counts_cover_the_closed_set(spark):
    counts = {r["reason"]: r["n"] for r in V.rejection_counts(checked(spark, [changed(sequence=-1)] * 3)).collect()}
    assert set(counts) == set(S.REASONS) and counts["invalid_sequence"] == 3 and sum(counts.values()) == 3


def test_batch_response_shows_the_first_fifty(spark):
    df = checked(spark, [changed(sequence=-1)] * 60 + [changed()] * 5).withColumn("batch_id", F.lit("b"))
    r = V.batch_response(df).first()
    assert (r["received"], r["accepted"], r["rejected"], r["rejections_truncated"]) == (65, 5, 60, True)
    assert [x["index"] for x in r["rejections"]] == list(range(50)) and r["rejection_counts"] == {"invalid_sequence": 60}
