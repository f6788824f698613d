import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse.functions.times import instant
import faults as I
from plantpulse.operators import validate as V
from plantpulse.schemas import MALFORMED_KINDS
from plantpulse.streaming import jobs


@pytest.fixture(scope="module")
def records(spark):
    df = spark.range(1, 2001).select(
        F.col("id").alias("row_no"), F.lit(1).cast("bigint").alias("schema_version"), F.format_string("e%d", "id").alias("event_id"), F.lit("d").alias("device_id"),
        F.date_format(F.timestamp_seconds(F.lit(1_736_928_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"),
        F.col("id").alias("sequence"), (F.col("id") % 90).cast("double").alias("temperature_c"), F.lit(1.5).alias("vibration_mm_s"), F.lit("s").alias("site_id"))
    return df.cache()


def body(r):
    return json.loads(r["body"])


def test_no_rates_change_nothing(records):
    plan = I.plan_faults(records, I.FaultRates(seed=1))
    assert plan.count() == 2000 and plan.where("kind <> 'ok' or copy_no <> 0").count() == 0
    assert plan.where(F.col("t_rel") != F.col("row_no") - 1).count() == 0


def test_plan_depends_on_the_seed_only(records):
    rates = I.FaultRates(seed=3, malformed=0.1, late=0.1, duplicate=0.1)
    one = rows(I.plan_faults(records, rates), "row_no", "copy_no", "kind", "body")
    assert one == rows(I.plan_faults(records.repartition(7), rates), "row_no", "copy_no", "kind", "body")
    assert one != rows(I.plan_faults(records, I.FaultRates(seed=4, malformed=0.1, late=0.1, duplicate=0.1)), "row_no", "copy_no", "kind", "body")


def test_rates_do_not_disturb_each_other(records):
    late = lambda df: {r["row_no"] for r in df.where("kind = 'late'").collect()}
    alone = late(I.plan_faults(records, I.FaultRates(seed=3, late=0.2)))
    mixed_plan = I.plan_faults(records, I.FaultRates(seed=3, late=0.2, malformed=0.3, duplicate=0.5))
    bad = {r["row_no"] for r in mixed_plan.where("kind = 'malformed'").collect()}
    assert late(mixed_plan) == alone - bad and 300 < len(alone) < 500
    assert {r["malformed_kind"] for r in mixed_plan.collect()} == {None, *MALFORMED_KINDS}


def test_faults_do_what_they_say(records):
    plan = I.plan_faults(records, I.FaultRates(seed=9, malformed=0.2, late=0.2, duplicate=0.2, late_seconds=60)).cache()
    found = plan.collect()
    by_row = {}
    for r in found:
        by_row.setdefault(r["row_no"], []).append(r)
    for group in by_row.values():
        assert len({r["body"] for r in group}) == 1 and len(group) <= (1 if group[0]["kind"] == "malformed" else 2)
    original = {r["row_no"]: r for r in records.collect()}
    for r in found:
        if r["kind"] == "late":
            b, o = body(r), original[r["row_no"]]
            assert b["event_time"] < o["event_time"] and b["event_id"] == o["event_id"] and b["temperature_c"] == o["temperature_c"]
    checked = V.validate(plan.select("kind", F.col("body").alias("raw"), instant("2025-02-01T00:00:00Z").alias("received_at")))
    assert checked.where("(kind = 'malformed') <> (reason is not null)").count() == 0
    counts = rows(I.fault_counts(plan).groupBy("kind").agg(F.sum("n").alias("n")), "kind", "n")
    assert counts == sorted([(k, sum(r["kind"] == k for r in found)) for k in ("duplicate", "late", "malformed")], key=repr)
    with pytest.raises(ValueError):
        I.FaultRates(malformed=1.1).check()
    with pytest.raises(ValueError):
        I.FaultRates(late_seconds=-1).check()


def line(batch, idx, event_id, sequence=None, temp=20.0, minute=0, device="d"):
    raw = {"schema_version": 1, "event_id": event_id, "device_id": device, "event_time": f"2025-01-15T08:{minute:02d}:00Z", "temperature_c": temp, "vibration_mm_s": 1.0}
    if sequence is not None:
        raw["sequence"] = sequence
    return json.dumps({"batch_id": str(batch), "idx": idx, "received_at": "2025-01-15T09:00:00.000Z", "raw": json.dumps(raw)})


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_stream_stores_each_reading_once(spark, tmp_path):
    source, place = str(tmp_path / "in"), jobs.Tables(str(tmp_path / "out"))
    put(source, "1.jsonl", [line(1, 0, "a", 1, temp=90.0), line(1, 1, "a", 2), line(1, 2, "b", 2, temp=999.0), line(1, 3, "c", 3)])
    jobs.run_ingest(spark, source, place)
    put(source, "2.jsonl", [line(2, 0, "a", 1, temp=90.0), line(2, 1, "x", 3), line(2, 2, "late", 9, minute=0, temp=95.0), line(2, 3, "e", 10, minute=30)])
    jobs.run_ingest(spark, source, place)
    stored = spark.read.parquet(place.events)
    assert rows(stored, "event_id") == [("a",), ("c",), ("e",), ("late",)]
    assert rows(spark.read.parquet(place.alerts), "alert_id") == [("a:temperature_high",), ("late:temperature_high",)]
    assert rows(spark.read.parquet(place.rejections), "batch_id", "idx", "reason") == [("1", 1, "duplicate_in_batch"), ("1", 2, "out_of_range")]
    metrics = rows(spark.read.parquet(place.metrics).where("n > 0 and metric = 'processed_events'"), "epoch", "label", "n")
    assert metrics == [(0, "stored", 2), (1, "duplicate", 2), (1, "stored", 2)]
    assert spark.read.parquet(place.frames).count() == 6
    assert rows(jobs.live_latest(spark, place), "device_id", "event_id") == [("d", "e")]
    assert jobs.live_trend(spark, place).first()["points"] == 4


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    place = jobs.Tables(str(tmp_path / "out"))
    parse = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").select(
        F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
    first = parse([line(1, 0, "a", 1, temp=90.0), line(1, 1, "b", 2)])
    second = parse([line(2, 0, "a", 1), line(2, 1, "c", 3, temp=91.0)])
    jobs.persist(first, 0, place)
    jobs.persist(second, 1, place)
    before = rows(spark.read.parquet(place.events), "event_id", "epoch"), rows(spark.read.parquet(place.alerts), "alert_id", "epoch")
    jobs.persist(second, 1, place)  # as after a crash between the writes
    assert before == (rows(spark.read.parquet(place.events), "event_id", "epoch"), rows(spark.read.parquet(place.alerts), "alert_id", "epoch"))
    assert before[1] == [("a:temperature_high", 0), ("c:temperature_high", 1)]


def test_live_thresholds(spark, tmp_path):
    place, settings = jobs.Tables(str(tmp_path / "out")), str(tmp_path / "settings")
    spark.sql("select timestamp'2025-01-01' valid_from, 10.0D temperature_c, 7.1D vibration_mm_s").write.parquet(settings)
    batch = spark.createDataFrame([(line(1, 0, "a", 1),)], "value string").select(F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
    jobs.persist(batch, 0, place, thresholds_path=settings)
    assert spark.read.parquet(place.alerts).first()["threshold"] == 10.0


def test_thresholds_change_inside_a_micro_batch(spark, tmp_path):
    """Each reading meets what held when it arrived; before the first setting the usual thresholds hold."""
    place, settings = jobs.Tables(str(tmp_path / "out")), str(tmp_path / "settings")
    spark.sql("select * from values (timestamp'2025-01-15 09:10:00', 10.0D, 7.1D), (timestamp'2025-01-15 09:20:00', 99.0D, 7.1D) as t(valid_from, temperature_c, vibration_mm_s)").write.parquet(settings)
    at = lambda text, minute: text.replace("T09:00:00.000Z", f"T09:{minute:02d}:00.000Z")
    texts = [at(line(1, i, f"e{i}", i, temp=temp), minute) for i, (minute, temp) in enumerate([(5, 20.0), (6, 90.0), (10, 20.0), (19, 9.0), (20, 90.0), (40, 99.0)])]
    batch = spark.createDataFrame([(x,) for x in texts], "value string").select(F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
    jobs.persist(batch, 0, place, thresholds_path=settings)
    assert rows(spark.read.parquet(place.alerts), "event_id", "threshold") == [("e1", 85.0), ("e2", 10.0), ("e5", 99.0)]


def test_the_earlier_arrival_is_stored_whatever_its_request_is_called(spark, tmp_path):
    place = jobs.Tables(str(tmp_path / "out"))
    early, late = line(9, 0, "a", 1, temp=1.0).replace("T09:00:00", "T08:59:59"), line(2, 0, "a", 1, temp=2.0)
    batch = spark.createDataFrame([(late,), (early,)], "value string").select(F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
    jobs.persist(batch, 0, place)
    assert rows(spark.read.parquet(place.events), "batch_id", "temperature_c") == [("9", 1.0)]


def test_bounded_state_dedup_and_seconds(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select * from values (timestamp'2025-01-15 08:00:00.1', 'a'), (timestamp'2025-01-15 08:00:00.9', 'a'), (timestamp'2025-01-15 08:00:01', 'b') as t(event_time, event_id)").write.parquet(source)
    schema = "event_time timestamp, event_id string"
    stream = jobs.dedup_stateful(spark.readStream.schema(schema).parquet(source), "1 minute")
    out = str(tmp_path / "dedup")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == [("a",), ("b",)]
    counts = jobs.run_per_second(spark, source, schema, str(tmp_path / "seconds"))
    assert [r["n"] for r in counts.orderBy("second").collect()] == [2, 1]


def test_seconds_are_merged_and_late_rows_count(spark, tmp_path, monkeypatch):
    """A file a micro-batch: few folders stay, and what comes late by hours or again in a micro-batch is counted once."""
    monkeypatch.setattr(jobs, "MERGE_EPOCHS", 4)
    source, want = str(tmp_path / "in"), {}
    for i in range(13):
        second = 5 if i == 11 else i // 2
        want[second] = want.get(second, 0) + 2
        spark.sql(f"select timestamp'2025-01-15 08:00:00' + make_dt_interval(0, 0, 0, {second} + d) event_time from values (0.1), (0.2) as t(d)").coalesce(1).write.mode("append").parquet(source)
    counts = jobs.run_per_second(spark, source, "event_time timestamp", str(tmp_path / "out"), max_files=1)
    found = {r["second"].second: r["n"] for r in counts.collect()}
    assert sorted(found.values()) == sorted(want.values()) and sum(found.values()) == 26
    base = str(tmp_path / "out" / "seconds")
    left = {name: jobs.written_numbers(spark, base, name) for name in ("epoch", "merged")}
    assert len(left["merged"]) == 2 and len(left["epoch"]) <= 8
    again = spark.sql("select timestamp'2025-01-15 09:00:00' event_time")
    for _ in range(2):
        jobs.count_seconds(again, 13, base)
    assert {r["n"] for r in jobs.counted_seconds(spark, base).where("minute(w.start) = 0 and hour(w.start) = 9").collect()} == {1}


def test_two_versions_of_the_trend_stay(spark, tmp_path):
    place = jobs.Tables(str(tmp_path / "out"))
    for epoch in range(4):
        batch = spark.createDataFrame([(line(epoch, 0, f"e{epoch}", epoch),)], "value string").select(F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
        jobs.persist(batch, epoch, place)
    assert jobs.written_numbers(spark, place.trend, "v") == [2, 3]
    assert rows(jobs.live_latest(spark, place), "event_id") == [("e3",)] and jobs.live_trend(spark, place).first()["points"] == 4


def test_stateless_validation_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "checked")
    put(source, "1.jsonl", [line(1, 0, "a", 1), line(1, 1, "bad id", 2)])
    put(source, "2.jsonl", [line(2, 0, "b", 1, minute=1)])
    checked = jobs.stream_ingest(spark, source, max_files=1)
    checked.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "batch_id", "idx", "reason") == [("1", 0, None), ("1", 1, "invalid_event_id"), ("2", 0, None)]


def test_horizon_limits_what_is_looked_up(spark, tmp_path):
    place = jobs.Tables(str(tmp_path / "out"))
    parse = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").select(
        F.from_json("value", jobs.LINE_SCHEMA).alias("r")).select("r.*")
    jobs.persist(parse([line(1, 0, "a", 1)]), 0, place)
    jobs.persist(parse([line(2, 0, "a", 1, minute=1)]), 1, place, horizon_days=0)
    assert spark.read.parquet(place.events).count() == 1
    moved = line(3, 0, "a", 1).replace("2025-01-15T08", "2025-01-10T08")
    jobs.persist(parse([moved]), 2, place, horizon_days=1)
    assert spark.read.parquet(place.events).count() == 2
