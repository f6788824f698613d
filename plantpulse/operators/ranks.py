"""Values at given ranks of groups of any size, by radix selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit: a window holds at most 2^21 rows of a group, however many different values the group has.
DIGIT = 21
#: Added to every value, so that digits of negative ones are in order.
OFFSET = 1 << 62


def select_ranks(values: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """`by, rank, value`: of each group the value at each wanted rank (from 1) in rising order.

    `values` has `by`, an integral `value` within 2^62 of zero and how often it counts, `n`; `wanted` has `by` and
    `rank`, from 1 to the sum of `n`. Values are counted by their highest digit, the digit that holds a rank is found, and
    only inside it the next digit is counted; rows combine before each shuffle and are never ordered.
    """
    shifted = values.select(*by, (F.col("value") + OFFSET).alias("_v"), "n")
    open_ranks = wanted.select(*by, "rank", F.col("rank").alias("_left"), F.lit(0).cast("bigint").alias("_prefix"))
    for level in (2, 1, 0):
        digits = shifted.select(*by, F.shiftright("_v", DIGIT * (level + 1)).alias("_prefix") if level < 2 else F.lit(0).cast("bigint").alias("_prefix"),
                                F.shiftright("_v", DIGIT * level).alias("_digit"), "n")
        counted = digits.join(open_ranks, [*by, "_prefix"]).groupBy(*by, "rank", "_left", "_digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counted.withColumn("_upto", upto).where("_upto >= _left AND _upto - n < _left")
        open_ranks = found.select(*by, "rank", (F.col("_left") - F.col("_upto") + F.col("n")).alias("_left"), F.col("_digit").alias("_prefix"))
    return open_ranks.select(*by, "rank", (F.col("_prefix") - OFFSET).alias("value"))
