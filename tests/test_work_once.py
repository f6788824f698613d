"""Work that grows with the input is done once per row, and only for the rows that need it."""

import random

from pyspark.sql import functions as F

from plantpulse.operators import dedup as D
from plantpulse.operators import metrics as M
from plantpulse.plans import queries, views


def test_only_rows_that_share_a_key_go_through_the_rounds(spark, monkeypatch):
    seen = []
    plain = D._first_under_both
    monkeypatch.setattr(D, "_first_under_both", lambda undecided: seen.append(undecided.count()) or plain(undecided))
    records = [(f"e{i}", f"d{i % 7}", i if i % 3 else None, i) for i in range(900)]
    # Two share an id, two a sequence; two without a sequence on one device share nothing.
    records += [("e5", "d9", 5000, 1000), ("x", "d1", 1, 1001), ("y", "d1", None, 1002), ("z", "d1", None, 1003)]
    df = spark.createDataFrame(records, "event_id string, device_id string, sequence bigint, idx int")
    out = D.first_accepted(df, ["event_id"], ["device_id", "sequence"], ["idx"])
    assert out.columns == [*df.columns, "outcome"]
    found = {r.idx: r.outcome for r in out.collect()}
    assert {i: o for i, o in found.items() if o != "accepted"} == {1000: "repeated_id", 1001: "repeated_sequence"}
    assert len(found) == len(records) and seen[0] == 4


def test_rows_of_one_hash_are_told_apart(spark, monkeypatch):
    """However keys collide in the count of keys, the outcome is that of the keys themselves."""
    rng = random.Random(3)
    records = [(rng.choice([None, *(f"e{k}" for k in range(40))]), f"d{rng.randrange(2)}", rng.choice([None, *range(40)]), i) for i in range(120)]
    df = spark.createDataFrame(records, "event_id string, device_id string, sequence bigint, idx int")
    run = lambda: sorted((r.idx, r.outcome) for r in D.first_accepted(df, ["event_id"], ["device_id", "sequence"], ["idx"]).collect())
    usual = run()
    plain = F.xxhash64
    monkeypatch.setattr(D.F, "xxhash64", lambda *cols: plain(*cols) % 3)
    assert run() == usual and len(usual) == len(records)


def test_metric_lines_are_taken_apart_once(spark):
    lines = spark.createDataFrame([
        (1, "# HELP x"), (1, 'pulse_processed_events_total{outcome="stored"} 4'), (1, 'pulse_processed_events_total{outcome="failed"} 1'),
        (2, 'pulse_processed_events_total{outcome="stored"} 9'), (2, "pulse_queue_depth 3"), (2, "pulse_queue_depth_limit 7"),
    ], "t bigint, line string")
    stored = M.scrape_long(lines).where("metric = 'stored'")
    assert sorted(map(tuple, stored.collect())) == [(1, "stored", 4.0), (2, "stored", 9.0)]
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2


def test_recording_is_decoded_before_it_is_put_in_order(spark, tmp_path):
    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 90).alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = queries._recording(spark, str(tmp_path))
    assert "parse_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == views.imported(spark, str(tmp_path)).count() > 300
