"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these: space and the control characters from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text in order; no words or no text: an empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def spread_key(*cols: Column) -> Column:
    """64-bit hash that tells nulls from values: xxhash64 alone skips nulls."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that no working column has, and the new name of each column."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(rows: DataFrame, names: dict[str, str], *added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the shielded rows under their own names, then the added ones; these replace columns of the same name."""
    return rows.select(*[F.col(new).alias(old) for old, new in names.items() if old not in (*added, *drop)], *added)
