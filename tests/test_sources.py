import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse.functions.times import instant
from plantpulse.operators import rebase, validate
from plantpulse.plans import views  # noqa: F401
from plantpulse.sources import mapping as P
from plantpulse.sources import readers as S

NOW = "2025-02-01T00:00:00Z"


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def reasons(done):
    return rows(done.checked(instant(NOW)), "row_no", "reason")


def test_csv_under_everyday_names(spark, tmp_path):
    path = write(
        tmp_path, "a.csv",
        "Timestamp, Machine ,Temp,Vibration,Operator\n"
        "2025-01-15T08:00:00Z,press-1,61.5,2.0,ann\n\n"
        "2025-01-15T08:00:01Z,press-1,999,2.0,bob\n"
        "2025-01-15T08:00:02Z,press-1,hot,2.0\n"
        "yesterday,press-1,,2.0,eve\n",
    )
    done = P.import_file(spark, path)
    assert done.format == "csv" and done.plan.ignored == ["Operator"] and done.derived_ids
    assert done.plan.mapped == {"Timestamp": "event_time", "Machine": "device_id", "Temp": "temperature_c", "Vibration": "vibration_mm_s"}
    assert reasons(done) == [(1, None), (2, "out_of_range"), (3, "malformed_json"), (4, "invalid_timestamp")]
    assert rows(done.rows, "event_id")[0] == ("press-1-1",)
    summary = P.dataset_summary(done, done.checked(instant(NOW))).first()
    assert (summary["rows"], summary["devices"], summary["problems"]) == (4, 1, 3)
    assert summary["derived"] == ["event_id (device id and row number)", "schema_version (1)"]
    assert (summary["first_time"], summary["last_time"]) == ("2025-01-15T08:00:00.000Z", "2025-01-15T08:00:02.000Z")


def test_csv_with_byte_mark_and_quotes(spark, tmp_path):
    path = write(
        tmp_path, "b.csv",
        'event_id,device_id,event_time,temperature_c,vibration_mm_s,sequence\n"a ""1""",d,2025-01-15T08:00:00Z,1e1,.5,9007199254740993\n'
        "b,d,2025-01-15T08:00:00Z,10,1,12.0\n",
        "utf-8-sig",
    )
    done = P.import_file(spark, path)
    assert rows(done.rows, "event_id", "temperature_c", "vibration_mm_s", "sequence") == [('a "1"', 10.0, 0.5, 9007199254740993), ("b", 10.0, 1.0, None)]
    assert reasons(done) == [(1, "invalid_event_id"), (2, "malformed_json")]


def test_ndjson_and_array(spark, tmp_path):
    record = {"device": "d", "time": "2025-01-15T08:00:00Z", "temp": 20, "vib": 1, "id": "x", "seq": 9007199254740993, "note": "n"}
    lines = "\n".join([json.dumps(record), "", json.dumps({**record, "temp": "hot"}), json.dumps({**record, "device": 5, "time": 7})])
    for name, text, fmt in (("c.jsonl", lines, "ndjson"), ("d.json", "  [" + ",".join(x for x in lines.split("\n") if x) + "]", "json")):
        done = P.import_file(spark, write(tmp_path, name, text))
        assert done.format == fmt and done.plan.ignored == ["note"] and not done.derived_ids
        assert done.plan.columns == ["device", "id", "note", "seq", "temp", "time", "vib"]
        assert reasons(done) == [(1, None), (2, "malformed_json"), (3, "malformed_json")]
        got = done.rows.where("row_no in (1, 3)").orderBy("row_no").collect()
        assert got[0]["sequence"] == 9007199254740993 and got[1]["event_time"] == "7" and got[1]["shape"] == "device_id"


def test_places_of_bad_content(spark, tmp_path):
    with pytest.raises(S.BadFile, match="empty"):
        P.import_file(spark, write(tmp_path, "e.csv", " \n"))
    with pytest.raises(S.BadFile, match="no rows"):
        P.import_file(spark, write(tmp_path, "f.csv", "time,device,temp,vib\n"))
    with pytest.raises(S.BadFile, match="line 3"):
        P.import_file(spark, write(tmp_path, "g.jsonl", '{"a":1}\n\nnope\n'))
    with pytest.raises(S.BadFile, match="item 2"):
        P.import_file(spark, write(tmp_path, "h.json", '[{"a":1},5]'))
    with pytest.raises(S.BadFile, match="not a valid JSON array"):
        P.import_file(spark, write(tmp_path, "i.json", "[{"))
    lenient = write(tmp_path, "j.jsonl", '{"a":1}\n\nnope\n[1]\n{"a":2}\n')
    assert rows(S.read_ndjson(spark, lenient), "row_no", "raw") == [(1, '{"a":1}'), (2, '{"a":2}')]
    assert S.unreadable_lines(spark, lenient).first()[0] == 2


def test_mapping_rules():
    plan = P.resolve_mapping(["temp", "temperature_c", "Time", "time utc", "Device-Name", "vib"])
    assert plan.fields == {"temperature_c": "temperature_c", "event_time": "Time", "device_id": "Device-Name", "vibration_mm_s": "vib"}
    assert plan.ignored == ["temp", "time utc"]
    german = ["Zeit", "Maschine", "Grad", "Schwingung", "Notiz"]
    with pytest.raises(P.NeedsMapping) as error:
        P.require_mapping(P.resolve_mapping(german))
    assert error.value.missing == ["event_time", "device_id", "temperature_c", "vibration_mm_s"]
    chosen = {"Zeit": "event_time", "Maschine": "device_id", "Grad": "temperature_c", "Schwingung": "vibration_mm_s", "Notiz": ""}
    assert P.require_mapping(P.resolve_mapping(german, chosen)).mapped == {k: v for k, v in chosen.items() if v}
    for bad, text in (({"x": "event_time"}, "no column"), ({"Zeit": "nope"}, "not a field"), ({"Zeit": "event_time", "Grad": "event_time"}, "two columns")):
        with pytest.raises(ValueError, match=text):
            P.resolve_mapping(german, bad)


def test_row_numbers_over_many_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for part in range(3):
            write(tmp_path, f"p{part}.txt", "".join(f"{part * 2000 + i}\n" + ("\n" if i % 7 == 0 else "") for i in range(2000)))
        df = S.with_row_no(spark.read.text(str(tmp_path)).where(F.trim("value") != ""))
        assert df.rdd.getNumPartitions() > 3
        assert df.where(F.col("row_no") != F.col("value").cast("int") + 1).count() == 0 and df.count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_envelopes_and_payload_shapes(spark):
    ok = '{"events":[{"b":1,"a":1e3},"text",null]}'
    bodies = [ok, "{", '{"events":[]}', "{}", '{"events":5}', "[1]", ok + "x", ok + " ] x", ok + ',{"a":1}', "null",
              '{"events":[' + ",".join(["1"] * 4) + "]}", '{"events":["' + "x" * 300 + '"]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = {r["i"]: r["error"] for r in S.batch_envelope(df, max_events=3, max_bytes=200).collect()}
    bad = "invalid_json"
    assert [got[i] for i in range(12)] == [None, bad, "empty_batch", "empty_batch", bad, bad, bad, bad, bad, "empty_batch", "batch_too_large", "payload_too_large"]
    assert [r["raw"] for r in S.explode_payload(df.where("i = 0")).orderBy("idx").collect()] == ['{"b":1,"a":1000.0}', '""', "null"]
    shapes = spark.createDataFrame([('[{"a":1},{"a":2}]', '{"a":1}\n\n{"a":2}\n', '{"a":1}')], "array string, ndjson string, single string")
    # The order of the keys stays; a number may be written in another way.
    for shape, n in (("array", 2), ("ndjson", 2), ("single", 1)):
        part = shapes.select(F.col(shape).alias("body"))
        assert [r["raw"] for r in S.explode_payload(part, shape).orderBy("idx").collect()] == ['{"a":1}', '{"a":2}'][:n]


def test_string_elements_are_not_objects(spark):
    """A JSON text inside a string is a string, whatever it spells."""
    inner = json.dumps({"schema_version": 1})
    df = spark.createDataFrame([(json.dumps({"events": [inner]}),)], "body string").withColumn("received_at", instant(NOW))
    assert validate.validate(S.explode_payload(df)).first()["reason"] == "malformed_json"


def test_rebase(spark):
    from datetime import datetime, timezone

    now = datetime(2025, 6, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame(
        [(1, "2020-01-01T00:00:10Z"), (2, "bad"), (3, "2020-01-01T00:00:40Z"), (4, "2020-01-01T00:00:00Z")], "row_no int, event_time string"
    )
    assert [r["event_time"] for r in rebase.rebase_latest(df, now).orderBy("row_no").collect()] == [
        "2025-05-31T23:59:30.000Z", "bad", "2025-06-01T00:00:00.000Z", "2025-05-31T23:59:20.000Z"]
    assert [r["event_time"] for r in rebase.rebase_first(df, now).orderBy("row_no").collect()][0] == "2025-06-01T00:00:00.000Z"
    bad = df.where("row_no = 2")
    assert rebase.rebase_latest(bad, now).first()["event_time"] == "bad"
