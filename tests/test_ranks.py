"""Values at ranks against sorted lists."""

import random

from conftest import rows
from pyspark.sql import functions as F

from plantpulse.operators.ranks import select_ranks


def test_ranks_are_those_of_a_sorted_list(spark):
    rng = random.Random(2)
    draw = {"a": lambda: rng.randrange(50), "b": lambda: rng.randrange(-(2**61), 2**61), "c": lambda: rng.choice([-5, 0, 2**21 - 1, 2**21, 2**42 - 1, 2**42]), "one": lambda: 7}
    counts = [(g, f(), rng.choice([1, 1, 3])) for g, f in draw.items() for _ in range(1 if g == "one" else 200)]
    lists = {g: sorted(v for h, v, n in counts if h == g for _ in range(n)) for g in draw}
    wanted = [(g, k) for g, vs in lists.items() for k in sorted({1, len(vs), *(rng.randint(1, len(vs)) for _ in range(9))})]
    df = spark.createDataFrame(counts, "g string, value long, n long").repartition(5)
    found = select_ranks(df, spark.createDataFrame(wanted, "g string, rank long"), ["g"])
    assert rows(found, "g", "rank", "value") == sorted(((g, k, lists[g][k - 1]) for g, k in wanted), key=repr)


def test_a_group_of_very_many_values_is_never_ordered(spark):
    """All values of one group differ; what a window sees are digits."""
    n = 300_000
    values = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") * 7_919 % n * 1_000_003).alias("value"), F.lit(1).cast("long").alias("n"))
    wanted = spark.createDataFrame([("hot", k) for k in (1, n // 2, n)], "g string, rank long")
    found = select_ranks(values, wanted, ["g"])
    assert rows(found, "rank", "value") == sorted(((k, (k - 1) * 1_000_003) for k in (1, n // 2, n)), key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3
