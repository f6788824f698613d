"""Every registered query against its SQL, on the smallest driver tables."""

import decimal
import os

import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF_DIR):
    pytest.skip("driver tables are not there", allow_module_level=True)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(values):
    return tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in values)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_same_rows(spark, sql, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted((plain(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = sql.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((plain(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_every_sql_has_a_query():
    queries, texts = entry_points.queries(), entry_points.oracle_sql()
    assert set(texts) <= set(queries)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["device_id", "rule", "n", "max_observed"] and df.count() > 0
