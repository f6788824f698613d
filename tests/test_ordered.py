"""Every ordered operator gives the same with whole groups and with groups cut into pieces."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plantpulse.operators.ordered import InOrder, global_rank


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    # One group holds most of the rows; values repeat so that runs cross the cuts.
    records = [
        ("hot" if rng.random() < 0.7 else f"g{rng.randrange(4)}", rng.randrange(1000), i, rng.choice([1.0, 1.0, 1.0, 2.0, None]))
        for i in range(600)
    ]
    return spark.createDataFrame(records, "g string, t int, n int, v double").cache(), records


def brute(records, f):
    out = []
    for g in {r[0] for r in records}:
        out += f(sorted((r for r in records if r[0] == g), key=lambda r: (r[1], r[2])))
    return sorted(out, key=repr)


def ordered(data, pieces):
    return InOrder(data, ["g"], ["t", "n"], pieces)


@pytest.mark.parametrize("pieces", [None, 1, 40])
def test_against_brute_force(data, pieces):
    df, records = data
    made = ordered(df, pieces)
    v = F.col("v")
    assert rows(made.rank("x"), "n", "x") == brute(records, lambda rs: [(r[2], i + 1) for i, r in enumerate(rs)])
    assert rows(made.lag(v, "x"), "n", "x") == brute(records, lambda rs: [(r[2], rs[i - 1][3] if i else None) for i, r in enumerate(rs)])
    assert rows(made.running_sum(F.coalesce(v, F.lit(0.0)), "x"), "n", "x") == brute(
        records, lambda rs: [(r[2], sum(p[3] or 0.0 for p in rs[: i + 1])) for i, r in enumerate(rs)]
    )
    assert rows(made.max_before(F.col("n"), "x"), "n", "x") == brute(
        records, lambda rs: [(r[2], max((p[2] for p in rs[:i]), default=None)) for i, r in enumerate(rs)]
    )
    last = lambda rs: next((p[3] for p in reversed(rs) if p[3] is not None), None)
    assert rows(made.last_known(v, "x"), "n", "x") == brute(records, lambda rs: [(r[2], last(rs[: i + 1])) for i, r in enumerate(rs)])


@pytest.mark.parametrize("pieces", [None, 1, 40])
@pytest.mark.parametrize("length", [2, 5])
def test_long_runs(data, pieces, length):
    df, records = data

    def count(rs):
        runs, n, prev = 0, 0, None
        for r in rs:
            n = n + 1 if r[3] is not None and r[3] == prev else 1
            prev = r[3]
            runs += r[3] is not None and n == length
        return [(rs[0][0], runs)]

    assert rows(ordered(df, pieces).long_runs({"x": F.col("v")}, length), "g", "x") == brute(records, count)


def test_rank_over_the_whole_table(data):
    df, records = data
    expected = [(r[2], i + 1) for i, r in enumerate(sorted(records, key=lambda r: (r[1], r[2])))]
    assert rows(global_rank(df, ["t", "n"], "x"), "n", "x") == sorted(expected, key=repr)
