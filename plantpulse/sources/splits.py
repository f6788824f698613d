"""CSV records and elements of JSON arrays out of files that are read in many splits.

Whether a line begins inside quotes, or a brace closes an element, depends on everything before it in the file. Each split
is summed up for every state it could begin in; the small table of splits is composed in file order, and after that the
state at each line of each split is known. Rows of one split are put in order by a window, so a task holds one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from plantpulse.session import pin, prepare

#: Byte order mark.
BOM = "\ufeff"

FILE, START, AT = "_file", "_start", "_at"


def _before_row() -> WindowSpec:
    """The rows of a split before each one."""
    return Window.partitionBy(FILE, START).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)


def _up_to_row() -> WindowSpec:
    return Window.partitionBy(FILE, START).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(value: Column, *by: str, order: str = START) -> Column:
    """Sum over the splits of a file before each one, or over the files before each one: one row each."""
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(over), F.lit(0))


def text_rows(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """`value` with file, split and place; the byte mark of a file is taken off."""
    rows = prepare(spark).read.option("lineSep", separator).text(path)
    placed = rows.select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START), F.monotonically_increasing_id().alias(AT), "value"
    )
    return placed.withColumn("value", F.regexp_replace("value", f"\\A{BOM}", ""))


# ---------------------------------------------------------------------------
# CSV
# ---------------------------------------------------------------------------
def _bad_quotes(line: Column, inside: Column) -> Column:
    """Whether a line breaks the rules of quotes, given whether it begins inside them.

    Between quotes the pieces of a line lie inside and outside in turn. A piece outside stands for an escaped quote when
    it is empty; else it goes from a closing quote to the next opening one, so a comma comes first and only white space
    behind the last comma. The first piece of a record has no closing quote before it, the last piece none to open.
    """
    pieces, last = F.split(line, '"'), F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    closes = lambda x: (x == "") | x.startswith(",")
    opens = lambda x: x.rlike(r"(?:\A|,)\s*\z")

    def broken(x: Column, i: Column) -> Column:
        outside = (i + inside) % 2 == 0
        return outside & ~(((i == 0) | closes(x)) & ((i == last) | (x == "") | opens(x)))

    return F.when(F.contains(line, F.lit('"')), F.exists(F.transform(pieces, broken), lambda b: b)).otherwise(F.lit(False))


class CsvRecords:
    """The records of CSV files: `record` (from 1 over all files in path order, blank lines uncounted), `header` and `text`.

    `error` holds the place and kind of the first fault, if there is one: a quote inside a bare cell, text behind a closing
    quote, or a quote that is never closed.
    """

    def __init__(self, spark: SparkSession, path: str):
        rows = text_rows(spark, path, "\n").withColumn("value", F.regexp_replace("value", r"\r\z", ""))
        quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("bigint")
        rows = rows.withColumn("_quotes", quotes).withColumn("_inside", F.coalesce(F.sum("_quotes").over(_before_row()), F.lit(0)) % 2)
        # For both states a split may begin in: how many records have begun up to each line.
        blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
        for state in (0, 1):
            begins = (F.col("_inside") == state) & ~blank
            rows = rows.withColumn(f"_begun{state}", F.sum(begins.cast("bigint")).over(_up_to_row()))
        lines = pin(rows.withColumn("_line", F.row_number().over(Window.partitionBy(FILE, START).orderBy(AT))))
        self.splits = pin(self._composed(lines))
        self.lines = lines.join(self.splits, [FILE, START]).select(
            FILE, (F.col("_line") + F.col("_lines_before")).alias("line"), "value", "_quotes", ((F.col("_inside") + F.col("_state")) % 2).alias("inside"),
            (F.when(F.col("_state") == 0, F.col("_begun0")).otherwise(F.col("_begun1")) + F.col("_begun_before")).alias("nth"), "_records_before", "_headers_before",
        )

    @staticmethod
    def _composed(lines: DataFrame) -> DataFrame:
        """State, lines and records before each split."""
        splits = lines.groupBy(FILE, START).agg(
            (F.sum("_quotes") % 2).alias("_parity"), F.count(F.lit(1)).alias("_lines"), F.max("_begun0").alias("_n0"), F.max("_begun1").alias("_n1")
        )
        splits = splits.withColumn("_state", _before(F.col("_parity"), FILE) % 2)
        splits = splits.withColumn("_n", F.when(F.col("_state") == 0, F.col("_n0")).otherwise(F.col("_n1")))
        splits = splits.withColumn("_begun_before", _before(F.col("_n"), FILE)).withColumn("_lines_before", _before(F.col("_lines"), FILE))
        files = splits.groupBy(FILE).agg(F.sum("_n").alias("_n"), (F.sum("_parity") % 2).alias("_open"))
        files = files.select(FILE, "_open", _before(F.col("_n"), order=FILE).alias("_records_before"), _before((F.col("_n") > 0).cast("bigint"), order=FILE).alias("_headers_before"))
        return splits.select(FILE, START, "_state", "_begun_before", "_lines_before").join(files, FILE)

    @property
    def error(self) -> str | None:
        wrong = self.lines.where(_bad_quotes(F.col("value"), F.col("inside").cast("int"))).select(FILE, "line", F.lit("a quote in the wrong place").alias("what"))
        ending = self.splits.where("_open = 1").select(FILE).distinct()
        opening = self.lines.where("inside = 0 and _quotes % 2 = 1").join(ending, FILE).groupBy(FILE).agg(F.max("line").alias("line"))
        found = wrong.unionByName(opening.withColumn("what", F.lit("the quote is never closed"))).orderBy(FILE, "line").first()
        return found and f"line {found['line']}: {found['what']}"

    @property
    def records(self) -> DataFrame:
        """`record, header, text`; `record` numbers the rows below the headers."""
        lines = self.lines.withColumn("record", F.col("nth") + F.col("_records_before") - F.col("_headers_before") - 1).withColumn("header", F.col("nth") == 1)
        whole = (F.col("inside") == 0) & (F.col("_quotes") % 2 == 0)
        # A blank line between records has the number of the one before.
        single = lines.where(whole & (F.trim(F.regexp_replace("value", r"\s", "")) != "")).select("record", "header", F.col("value").alias("text"))
        parts = lines.where(~whole).groupBy("record", "header", FILE).agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("lines"))
        return single.unionByName(parts.select("record", "header", F.array_join(F.col("lines.value"), "\n").alias("text")))


def cells(record: Column, n: int) -> Column:
    """The first `n` cells of a CSV record as a struct `c0, c1, …`; missing ones are NULL."""
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxColumns": str(max(n, 20480)), "multiLine": "true"}
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(n)), options)


# ---------------------------------------------------------------------------
# JSON arrays
# ---------------------------------------------------------------------------
def _depth(text: Column, inside: int) -> Column:
    """Opening less closing brackets outside strings of a piece of JSON that begins inside a string or not."""
    outside = F.array_join(F.filter(F.split(text, '"'), lambda _, i: i % 2 == inside), "")
    count = lambda c: F.length(outside) - F.length(F.replace(outside, F.lit(c), F.lit("")))
    return count("{") + count("[") - count("]") - count("}")


class ArrayElements:
    """The elements of JSON arrays, one array per file: `file, element` (from 0 in its file) and `text` with what is around it.

    Files are cut at closing braces, wherever they stand; a piece ends an element when its brace lies outside strings and
    leads back into the array. What follows the last brace of a file is its `tail`.
    """

    def __init__(self, spark: SparkSession, path: str):
        rows = text_rows(spark, path, "}")
        bare = F.regexp_replace("value", r"(?s)\\.", "")
        rows = rows.withColumn("_bare", bare)
        quotes = (F.length("_bare") - F.length(F.replace("_bare", F.lit('"'), F.lit("")))).cast("bigint")
        rows = rows.withColumn("_quotes", quotes).withColumn("_d0", _depth(F.col("_bare"), 0).cast("bigint")).withColumn("_d1", _depth(F.col("_bare"), 1).cast("bigint")).drop("_bare")
        rows = rows.withColumn("_after", F.sum("_quotes").over(_up_to_row()) % 2).withColumn("_inside", (F.col("_after") + F.col("_quotes")) % 2)
        # For both states a split may begin in: the depth after each piece and its brace, counted from the split's begin.
        for state in (0, 1):
            step = F.when(F.col("_inside") == state, F.col("_d0")).otherwise(F.col("_d1")) - (F.col("_after") == state).cast("bigint")
            rows = rows.withColumn(f"_depth{state}", F.sum(step).over(_up_to_row()))
        pieces = pin(rows)
        splits = pieces.groupBy(FILE, START).agg((F.sum("_quotes") % 2).alias("_parity"), *[F.max_by(f"_depth{s}", AT).alias(f"_total{s}") for s in (0, 1)])
        splits = splits.withColumn("_state", _before(F.col("_parity"), FILE) % 2)
        splits = splits.withColumn("_from", _before(F.when(F.col("_state") == 0, F.col("_total0")).otherwise(F.col("_total1")), FILE))
        placed = pieces.join(splits.select(FILE, START, "_state", "_from"), [FILE, START])
        depth = F.when(F.col("_state") == 0, F.col("_depth0")).otherwise(F.col("_depth1")) + F.col("_from")
        ends = ((F.col("_after") == F.col("_state")) & (depth == 1)).cast("bigint")
        placed = placed.select(FILE, START, AT, "value", ends.alias("_ends"))
        counted = pin(placed.withColumn("_nth", F.coalesce(F.sum("_ends").over(_before_row()), F.lit(0))))
        sizes = counted.groupBy(FILE, START).agg(F.sum("_ends").alias("_n"), F.max(F.struct(START, AT)).alias("_end"))
        offsets = sizes.select(FILE, START, _before(F.col("_n"), FILE).alias("_offset"), F.max("_end").over(Window.partitionBy(FILE)).alias("_end"))
        # Places of rows grow inside a split only, so a row's place in its file is that of its split and its own.
        place = F.struct(START, AT)
        self.pieces = counted.join(offsets, [FILE, START]).select(
            F.col(FILE).alias("file"), place.alias("place"), "value", (F.col("_nth") + F.col("_offset")).alias("element"), (place == F.col("_end")).alias("is_tail")
        )

    @property
    def elements(self) -> DataFrame:
        pieces = self.pieces.where("not is_tail")
        joined = pieces.groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))
        return joined.select("file", "element", F.concat(F.array_join("parts.value", "}"), F.lit("}")).alias("text"))

    @property
    def tails(self) -> DataFrame:
        return self.pieces.where("is_tail").select("file", "element", F.col("value").alias("text"))
