import json
from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse.functions.cursors import decode_cursor, encode_cursor
from plantpulse.functions.times import format_nano, instant
from plantpulse.operators import alerts as A
from plantpulse.operators import store as Q
from plantpulse.operators.dedup import insert_new, stored_rows
from plantpulse.operators.validate import accepted, validate
from plantpulse.schemas import Thresholds
from plantpulse.sources import exports

DEVICES = ["press-01", "pump-02", "mill-03"]


def sample_rows():
    """Three devices for ten seconds with both thresholds met, just missed, and crossed together."""
    special = {(0, 3): (84.99, 2.0), (0, 5): (85.0, 2.0), (1, 3): (50.0, 7.1), (1, 4): (50.0, 7.09), (2, 8): (90.0, 8.0), (0, 9): (86.5, 1.0), (2, 2): (70.0, 7.5)}
    out = []
    for second in range(10):
        for i, device in enumerate(DEVICES):
            temp, vib = special.get((i, second), (60.0 + second, 2.0))
            out.append({
                "schema_version": 1, "event_id": f"{device}-{second + 1:06d}", "device_id": device,
                "event_time": f"2025-01-15T08:00:{second:02d}.000Z", "sequence": second + 1, "temperature_c": temp,
                "vibration_mm_s": vib, "site_id": "plant-a",
            })
    return out


@pytest.fixture(scope="module")
def events(spark):
    raw = [(i, json.dumps(r)) for i, r in enumerate(sample_rows())]
    df = spark.createDataFrame(raw, "idx int, raw string").withColumn("received_at", instant("2025-01-15T08:05:00Z"))
    return accepted(validate(df)).withColumn("batch_id", F.lit("b")).cache()


def test_golden_sample_raises_six_alerts(events):
    got = rows(A.evaluate_alerts(events), "alert_id", "threshold", "observed")
    assert got == sorted([
        ("press-01-000006:temperature_high", 85.0, 85.0), ("press-01-000010:temperature_high", 85.0, 86.5),
        ("mill-03-000009:temperature_high", 85.0, 90.0), ("mill-03-000009:vibration_high", 7.1, 8.0),
        ("mill-03-000003:vibration_high", 7.1, 7.5), ("pump-02-000004:vibration_high", 7.1, 7.1)], key=repr)
    assert rows(A.alert_counts(A.evaluate_alerts(events)), "rule", "n") == [("temperature_high", 3), ("vibration_high", 3)]


def test_replay_stores_and_alerts_nothing(events):
    stored = stored_rows(insert_new(events, None, ["idx"]))
    assert stored.count() == 30
    again = insert_new(events, stored, ["idx"])
    assert rows(again.groupBy("outcome").count(), "outcome", "count") == [("duplicate", 30)]
    assert A.alerts_for_new(again).count() == 0
    fired = A.evaluate_alerts(events)
    assert A.merge_alerts(fired, fired).count() == 0 and A.merge_alerts(fired.union(fired), fired.limit(0)).count() == 6


def test_threshold_history(spark, events):
    history = spark.createDataFrame(
        [("2025-01-15 08:00:03", 60.0, 7.1), ("2025-01-15 08:00:07", 200.0, 50.0)], "v string, temperature_c double, vibration_mm_s double"
    ).select(F.col("v").cast("timestamp").alias("valid_from"), "temperature_c", "vibration_mm_s")
    dated = events.withColumn("processed_at", F.col("event_time"))
    short = rows(A.evaluate_with_history(dated, history), "alert_id", "threshold")
    expected = []
    for r in sample_rows():
        second = int(r["event_time"][17:19])
        t, v = (60.0, 7.1) if 3 <= second < 7 else (200.0, 50.0) if second >= 7 else (1e9, 1e9)
        expected += [(r["event_id"] + ":temperature_high", t)] if r["temperature_c"] >= t else []
        expected += [(r["event_id"] + ":vibration_high", v)] if r["vibration_mm_s"] >= v else []
    assert short == sorted(expected, key=repr)


def test_threshold_checks():
    Thresholds(85, 7.1).check(positive=True)
    for bad in (Thresholds(300, 1), Thresholds(10, 101), Thresholds(10, -1)):
        with pytest.raises(ValueError):
            bad.check()
    with pytest.raises(ValueError):
        Thresholds(0, 1).check(positive=True)


def walk(df, kind="events", **kw):
    seen, cursor, n = [], None, 0
    while True:
        page = Q.page(df, Q.make_query(cursor=cursor, browse=True, **kw), kind).orderBy("event_time", Q.IDS[kind]).collect()
        seen += [r[Q.IDS[kind]] for r in page]
        n += 1
        cursor = next((r["next_cursor"] for r in page if r["next_cursor"]), None)
        if cursor is None:
            return seen, n


def test_pages_visit_every_row_once(events):
    order = [r["event_id"] for r in events.orderBy("event_time", "event_id").collect()]
    assert walk(events, limit=7) == (order, 5)
    assert walk(events, limit=10, device_id="pump-02")[1] == 1
    q = Q.make_query("2025-01-15T08:00:02Z", "2025-01-15T08:00:04Z")
    assert Q.page(events, q).count() == 6
    numbered = {r["event_id"]: r["page"] for r in Q.pages(events, Q.make_query(browse=True, limit=7)).collect()}
    assert numbered == {e: i // 7 for i, e in enumerate(order)}


def test_page_is_a_top_n(events):
    plan = Q.page(events, Q.make_query(browse=True, limit=7))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_query_arguments():
    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    assert Q.make_query(browse=True, now=now).end.year == 2026
    for kw, text in (
        (dict(), "from is required"), (dict(start="2025-01-01T00:00:00Z"), "to is required"), (dict(start="x", end="y"), "from must be an RFC"),
        (dict(start="2025-01-02T00:00:00Z", end="2025-01-01T00:00:00Z"), "before"), (dict(start="2025-01-01T00:00:00Z", end="2025-01-02T00:00:01Z"), "range"),
        (dict(browse=True, limit="0"), "limit"), (dict(browse=True, limit=1001), "limit"), (dict(browse=True, device_id="a b"), "device_id"),
    ):
        with pytest.raises(ValueError, match=text):
            Q.make_query(**kw)
    t = datetime(2025, 1, 15, 8, 0, 0, 123456, tzinfo=timezone.utc)
    assert decode_cursor(encode_cursor(t, "a|b")) == (t, "a|b")
    for bad in ("", "***", "bm9iYXI", "MTJ8"):
        with pytest.raises(ValueError):
            decode_cursor(bad)


def test_stored_table_is_pruned_and_cleared(spark, events, tmp_path):
    paths = str(tmp_path / "events"), str(tmp_path / "alerts")
    Q.write_rows(events, paths[0])
    Q.write_rows(A.evaluate_alerts(events), paths[1])
    stored = spark.read.parquet(paths[0])
    hit = Q.selected(stored, Q.make_query("2025-01-15T08:00:02Z", "2025-01-15T08:00:04Z", device_id="pump-02"))
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert hit.count() == 2 and "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(event_time)" in plan
    with pytest.raises(ValueError):
        Q.clear_data(spark, *paths, confirm="yes")
    assert Q.clear_data(spark, *paths, confirm="DELETE").first()[:] == (30, 6)
    assert spark.read.parquet(paths[0]).count() == 0
    empty = Q.storage_stats(spark.read.parquet(paths[0]), spark.read.parquet(paths[1])).first()
    assert (empty["events"], empty["devices"], empty["first_event"], empty["alerts"]) == (0, 0, None, 0)


def test_exports(spark, events, tmp_path):
    q = Q.make_query(browse=True)
    exports.export_csv(events, q, str(tmp_path / "csv"))
    text = spark.read.text(str(tmp_path / "csv")).collect()
    assert text[0][0] == "event_id,device_id,site_id,event_time,received_at,sequence,temperature_c,vibration_mm_s"
    assert text[1][0] == "mill-03-000001,mill-03,plant-a,2025-01-15T08:00:00Z,2025-01-15T08:05:00Z,1,60,2"
    bare = events.withColumn("sequence", F.lit(None).cast("bigint")).withColumn("site_id", F.lit(""))
    assert rows(exports.csv_rows(bare, q), "sequence", "site_id")[0] == ("", "")
    objects = [json.loads(r["value"]) for r in exports.ndjson_rows(bare, q).collect()]
    assert len(objects) == 30 and "sequence" not in objects[0] and "site_id" not in objects[0]
    pages = exports.json_pages(events, q, rows=7).orderBy("page").collect()
    ids = [o["event_id"] for p in pages for o in json.loads(p["value"])]
    assert [len(json.loads(p["value"])) for p in pages] == [7, 7, 7, 7, 2]
    assert ids == [r["event_id"] for r in events.orderBy("event_time", "event_id").collect()]


def test_text_helpers(spark):
    from plantpulse.functions import text as X

    urls = ["http://u:p@h:8080/a?key=1#f", " https://h/x ", "nonsense", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(X.display_address(F.col("u"))).collect()] == ["http://h:8080", "https://h", "", ""]
    assert df.select(X.saved_address(F.col("u"))).first()[0] == "http://h:8080/a"
    numbers = spark.createDataFrame([(85.0,), (0.00001,), (1.5e10,), (-2.5e-7,), (0.1,), (100.0,), (0.0,)], "v double")
    assert [r[0] for r in numbers.select(X.plain_number(F.col("v"))).collect()] == ["85", "0.00001", "15000000000", "-0.00000025", "0.1", "100", "0"]
    lines = spark.createDataFrame([("a\x00b\n\n c",), ("x" * 400,)], "t string").select(X.clean_excerpt(F.col("t"), 300).alias("t"))
    assert [r["t"] for r in lines.collect()] == ["a b c", "x" * 300 + "…"]
    names = spark.createDataFrame([("/a/b/c.csv",), ("C:\\x\\y.csv",), ("/a/",), ("n" * 90,)], "p string").select(X.base_name(F.col("p")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["c.csv", "y.csv", "imported file", "n" * 80]
    hidden = spark.sql("select map('Authorization', 'secret') as h").select(X.hide_header_values(F.col("h")).alias("h")).first()["h"]
    assert hidden == {"Authorization": "(hidden)"}
    times = spark.createDataFrame([("2025-01-15 08:00:00.120300",), ("2025-01-15 08:00:10",)], "t string").select(format_nano(F.col("t").cast("timestamp")).alias("t"))
    assert [r["t"] for r in times.collect()] == ["2025-01-15T08:00:00.1203Z", "2025-01-15T08:00:10Z"]


def test_many_states_equal_single_ones(events):
    messages = events.select(F.col("idx").cast("bigint").alias("offset"), F.lit("event").alias("type"), "device_id", "event_id", "event_time",
                             "temperature_c", "vibration_mm_s", F.lit(None).cast("string").alias("rule"))
    many = rows(Q.states_as_of(messages, [0, 4, 29]), "asked", "device_id", "event_id")
    single = [(t, r["device_id"], r["event_id"]) for t in (0, 4, 29) for r in Q.state_as_of(messages, t)["devices"].collect()]
    assert many == sorted(single, key=repr)
