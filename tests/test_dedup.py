import random

from conftest import rows
from pyspark.sql import functions as F

from plantpulse.operators import dedup as D

SCHEMA = "batch string, event_id string, device_id string, sequence bigint, idx int"


def scan(records, scoped=True):
    """What a scan in order keeps, told row by row."""
    ids, seqs, out = set(), set(), {}
    for batch, event_id, device, sequence, idx in sorted(records, key=lambda r: (r[0], r[4])):
        scope = batch if scoped else ""
        if (scope, event_id) in ids:
            out[batch, idx] = "repeated_id"
        elif sequence is not None and (scope, device, sequence) in seqs:
            out[batch, idx] = "repeated_sequence"
        else:
            out[batch, idx] = "accepted"
            ids.add((scope, event_id))
            seqs.add((scope, device, sequence))
    return out


def run(spark, records, scoped=True, **kw):
    df = spark.createDataFrame(records, SCHEMA)
    keys = (["batch", "event_id"], ["batch", "device_id", "sequence"]) if scoped else (["event_id"], ["device_id", "sequence"])
    return {(r["batch"], r["idx"]): r["outcome"] for r in D.first_accepted(df, *keys, ["batch", "idx"], **kw).collect()}


def test_rejected_row_blocks_nobody(spark):
    records = [("b", "a", "d1", 1, 0), ("b", "a", "d2", None, 1), ("b", "b", "d1", 1, 2), ("b", "c", "d2", 1, 3), ("b", "b", "d1", 2, 4)]
    got = run(spark, records)
    assert [got["b", i] for i in range(5)] == ["accepted", "repeated_id", "repeated_sequence", "accepted", "accepted"]


def test_equals_a_sequential_scan(spark):
    rng = random.Random(5)
    records = [
        (f"b{i % 40}", f"e{rng.randrange(8)}", f"d{rng.randrange(2)}", rng.choice([None, *range(6)]), i // 40) for i in range(1200)
    ]
    assert run(spark, records) == scan(records)
    assert run(spark, records, scoped=False) == scan(records, scoped=False)


def test_one_key_with_a_third_of_all_rows(spark):
    records = [("b", "hot" if i % 3 == 0 else f"e{i}", "d", i, i) for i in range(900)]
    assert run(spark, records) == scan(records)


def test_a_long_chain_takes_a_few_joins(spark, monkeypatch):
    """Row 2k shares its id with row 2k+1, which shares its sequence with row 2k+2."""
    written = []
    plain = D.pin
    monkeypatch.setattr(D, "pin", lambda df: written.append(1) or plain(df))
    n = 100_000
    df = spark.range(n).select(
        F.lit("b").alias("batch"), F.format_string("e%d", F.floor(F.col("id") / 2)).alias("event_id"), F.lit("d").alias("device_id"),
        F.floor((F.col("id") + 1) / 2).alias("sequence"), F.col("id").cast("int").alias("idx"))
    out = D.first_accepted(df, ["event_id"], ["device_id", "sequence"], ["idx"])
    assert out.where((F.col("outcome") == "accepted") != (F.col("idx") % 2 == 0)).isEmpty() and out.count() == n
    assert len(written) <= 25


def test_tangled_conflicts_equal_a_scan(spark):
    """Chains that meet and part: two ids and sequences in common with near rows, in changing order."""
    rng = random.Random(8)
    for width in (1, 2, 3):
        records = [("b", f"e{(i + rng.randrange(width)) // 2}", "d", (i + 1 + rng.randrange(width)) // 2, i) for i in range(150)]
        assert run(spark, records, scoped=False) == scan(records, scoped=False)


def store(spark, records):
    return spark.createDataFrame(records, "event_id string, device_id string, sequence bigint")


def test_insert_skips_what_is_stored(spark):
    old = store(spark, [("a", "d1", 1), ("z", "d9", None)])
    new = spark.createDataFrame(
        [("a", "d5", 9, 0), ("b", "d1", 1, 1), ("c", "d2", 1, 2), ("n1", "d1", None, 3), ("n2", "d1", None, 4), ("c", "d7", 7, 5)],
        "event_id string, device_id string, sequence bigint, idx int",
    )
    got = rows(D.insert_new(new, old, ["idx"]), "idx", "outcome")
    assert got == [(0, "duplicate"), (1, "duplicate"), (2, "stored"), (3, "stored"), (4, "stored"), (5, "duplicate")]
    assert rows(D.processed_outcomes(D.insert_new(new, None, ["idx"])), "outcome", "n") == [("duplicate", 1), ("failed", 0), ("stored", 5)]


def test_batch_duplicates_get_the_reason_of_the_key(spark):
    df = spark.createDataFrame(
        [("b", 0, "a", "d1", 1, None), ("b", 1, "a", "d2", 2, None), ("b", 2, "b", "d1", 1, None), ("b", 3, "x", "d1", 1, "out_of_range")],
        "batch_id string, idx int, event_id string, device_id string, sequence bigint, reason string",
    ).withColumn("detail", F.lit(None).cast("string"))
    got = [(r["idx"], r["reason"], r["detail"]) for r in D.dedup_in_batch(df).orderBy("idx").collect()]
    assert got == [
        (0, None, None),
        (1, "duplicate_in_batch", "event_id already appears earlier in this batch"),
        (2, "duplicate_in_batch", "device_id and sequence already appear earlier in this batch"),
        (3, "out_of_range", None),
    ]


def test_a_hot_key_is_split_by_adaptive_execution(spark):
    """The join back to the rows has one row per key on its other side, so a hot key can be cut into parts."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(30_000).repartition(8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("e%d", "id")).alias("event_id"), F.lit("d").alias("device_id"),
            F.col("id").alias("sequence"), F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        marked = D.first_accepted(df, ["event_id"], ["device_id", "sequence"], ["idx"])
        assert marked.where("outcome = 'accepted'").count() == 20_001
        marked.write.format("noop").mode("overwrite").save()
        counted = marked.select("idx", "outcome", "payload")
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_request_that_arrives_twice_is_stored_once(spark):
    df = spark.createDataFrame([(7, 0, "e1", "d1", 1), (7, 0, "e1", "d1", 1), (7, 0, "e2", "d1", 2), (8, 0, "e1", "d1", 9), (7, 1, "e3", "d1", 2)],
                               "batch_id int, idx int, event_id string, device_id string, sequence long")
    out = D.insert_new(df, None, ["batch_id", "idx"])
    assert rows(out.where("outcome = 'stored'"), "batch_id", "idx", "event_id") == [(7, 0, "e1"), (7, 0, "e2")]
    assert out.count() == 5


def test_chains_beside_each_other(spark):
    """Row i shares its id with row i - 1 and its sequence with row i + 1, or the other way round, in two chains."""
    links = [(c, i, f"{c}{(i + 1) // 2}", f"d{c}", i // 2) for c in "ab" for i in range(61)]
    df = spark.createDataFrame(links, "c string, idx int, event_id string, device_id string, sequence long")
    out = D.first_accepted(df, ["event_id"], ["device_id", "sequence"], ["idx", "c"])
    ids, seqs, want = set(), set(), []
    for c, i, e, d, s in sorted(links, key=lambda r: (r[1], r[0])):
        if e not in ids and (d, s) not in seqs:
            want.append((c, i))
            ids.add(e)
            seqs.add((d, s))
    assert rows(out.where("outcome = 'accepted'"), "c", "idx") == sorted(want, key=repr)
