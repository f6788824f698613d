"""Row order inside groups of any size.

A window gives one task the whole group, which is not for a device, run or metric that holds a third of all rows.
`InOrder` range-partitions the rows by group and order, so that a large group spreads over many partitions; each piece
is worked on alone and what crosses a boundary (a count, a last value, a running maximum) is carried between pieces
through a table with one row per group and piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantpulse.session import pin

PIECE = "_piece"


class InOrder:
    """`df` ordered by `order` (unique within a group) inside groups `by`, in `pieces` partitions or Spark's choice."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], pieces: int | None = None):
        self.by, self.order = by, order
        keys = [F.col(c) for c in (*by, *order)]
        cut = df.repartitionByRange(pieces, *keys) if pieces else df.repartitionByRange(*keys)
        # Pinned: the pieces are read more than once, and a second sampling would draw other bounds.
        self.df = pin(cut.withColumn(PIECE, F.spark_partition_id()))

    @property
    def keys(self) -> list[str]:
        return [*self.by, PIECE]

    def window(self) -> WindowSpec:
        """Window inside a piece."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _across(self) -> WindowSpec:
        """Over the pieces of a group; as many rows as pieces."""
        return Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(PIECE)

    def _last_first(self) -> Column:
        return F.struct(*self.order)

    def _carried(self, per_piece: Column, combine, rows: DataFrame) -> DataFrame:
        """Join `_carry`, a value combined from the earlier pieces of the group, to the rows of each piece."""
        edges = self.df.groupBy(*self.keys).agg(per_piece.alias("_edge"))
        carry = edges.select(*self.keys, combine(F.col("_edge"), self._across()).alias("_carry"))
        return rows.join(carry, self.keys, "left")

    def rank(self, out: str) -> DataFrame:
        """Row number inside the group."""
        rows = self.df.withColumn(out, F.row_number().over(self.window()).cast("bigint"))
        before = lambda edge, over: F.sum(edge).over(over.rowsBetween(Window.unboundedPreceding, -1))
        joined = self._carried(F.count("*"), before, rows)
        return joined.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry", PIECE)

    def lag(self, value: Column, out: str) -> DataFrame:
        """Value of the previous row of the group."""
        rows = self.df.withColumn("_value", value).withColumn(out, F.lag("_value").over(self.window()))
        rows = rows.withColumn("_at_start", F.row_number().over(self.window()) == 1)
        joined = self._carried(F.max_by(value, self._last_first()), lambda edge, over: F.lag(edge).over(over), rows)
        return joined.withColumn(
            out, F.when(F.col("_at_start"), F.col("_carry")).otherwise(F.col(out))
        ).drop("_carry", "_value", "_at_start", PIECE)

    def running_sum(self, value: Column, out: str) -> DataFrame:
        rows = self.df.withColumn(
            out, F.sum(value).over(self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        before = lambda edge, over: F.sum(edge).over(over.rowsBetween(Window.unboundedPreceding, -1))
        joined = self._carried(F.sum(value), before, rows)
        return joined.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry", PIECE)

    def max_before(self, value: Column, out: str) -> DataFrame:
        """Largest value among the earlier rows of the group."""
        rows = self.df.withColumn(out, F.max(value).over(self.window().rowsBetween(Window.unboundedPreceding, -1)))
        before = lambda edge, over: F.max(edge).over(over.rowsBetween(Window.unboundedPreceding, -1))
        joined = self._carried(F.max(value), before, rows)
        return joined.withColumn(out, F.greatest(F.col(out), F.col("_carry"))).drop("_carry", PIECE)

    def last_known(self, value: Column, out: str) -> DataFrame:
        """Latest non-NULL value at or before each row."""
        frame = self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
        latest = F.max_by(value, F.when(value.isNotNull(), self._last_first()))
        before = lambda edge, over: F.last(edge, ignorenulls=True).over(
            over.rowsBetween(Window.unboundedPreceding, -1)
        )
        joined = self._carried(latest, before, rows)
        return joined.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop("_carry", PIECE)

    def long_runs(self, values: dict[str, Column], length: int) -> DataFrame:
        """Per group, the number of runs of at least `length` equal consecutive values; NULL breaks a run."""
        out = None
        for name, value in values.items():
            counted = self._runs_over_pieces(value, length, name)
            out = counted if out is None else out.join(counted, self.by, "full")
        return out.select(*self.by, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in values])

    def _runs_over_pieces(self, value: Column, length: int, out: str) -> DataFrame:
        window = self.window()
        rows = self.df.withColumn("_value", value)
        starts = F.coalesce(F.col("_value") != F.lag("_value").over(window), F.lit(True))
        runs = (
            rows.withColumn("_start", starts.cast("int"))
            .withColumn("_run", F.sum("_start").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*self.keys, "_run")
            .agg(F.count("*").alias("_n"), F.first("_value").alias("_value"))
            .withColumn("_last", F.max("_run").over(Window.partitionBy(*self.keys)))
            .withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.col("_last")))
        )
        inner = (
            runs.where(~F.col("_edge") & F.col("_value").isNotNull() & (F.col("_n") >= length))
            .groupBy(*self.by)
            .agg(F.count("*").alias("_c"))
        )
        order = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy(PIECE, "_run")
        apart = (F.lag(PIECE).over(order) == F.col(PIECE)) | (F.lag("_value").over(order) != F.col("_value"))
        joined = (
            runs.where("_edge")
            .withColumn("_start", F.coalesce(apart, F.lit(True)).cast("int"))
            .withColumn("_group", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*self.by, "_group")
            .agg(F.sum("_n").alias("_n"), F.first("_value").alias("_value"))
            .groupBy(*self.by)
            .agg(F.count_if(F.col("_value").isNotNull() & (F.col("_n") >= length)).alias("_c"))
        )
        return inner.unionByName(joined).groupBy(*self.by).agg(F.sum("_c").alias(out))


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return InOrder(df, by, order).last_known(F.col(value), out)


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Row number over the whole table in key order (used to cut a sorted export into pages)."""
    return InOrder(df, [], order).rank(out)
