"""Reading recordings and request bodies."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.text import base_name
from plantpulse.session import once, pin, prepare
from plantpulse.sources import splits
from plantpulse.sources.splits import BOM


class BadFile(ValueError):
    """A file that cannot be imported; the text names the place."""


def with_row_no(df: DataFrame, out: str = "row_no") -> DataFrame:
    """Number the rows of a file scan from 1 in file order.

    Rows of one split are contiguous, so a row's place in its split is a difference of increasing ids; the start of
    each split comes from the summed sizes of the splits before it. Only the table of splits is sorted. `df` must be
    a file scan, possibly filtered, and files count in path order.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = (
        placed.groupBy("_file", "_start")
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = placed.join(splits, ["_file", "_start"])
    return numbered.withColumn(out, F.col("_at") - F.col("_first") + F.col("_offset") + 1).drop(
        "_file", "_start", "_at", "_first", "_offset"
    )


def detect_format(spark: SparkSession, path: str) -> str:
    """json, ndjson or csv by the first character that is not blank."""
    text = F.regexp_replace("value", f"\\A{BOM}", "")
    # Cut at commas: a whole array may be one line.
    first = spark.read.option("lineSep", ",").text(path).select(F.ltrim(text).alias("v")).where(F.trim(F.regexp_replace("v", r"\s", "")) != "").head(1)
    if not first:
        raise BadFile("the file is empty")
    return {"[": "json", "{": "ndjson"}.get(first[0]["v"].lstrip()[0], "csv")


def ndjson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its number, and whether it holds a JSON object: (line_no, raw, readable). Blank lines are
    numbered but left out."""
    lines = with_row_no(prepare(spark).read.text(path), "line_no")
    raw = F.regexp_replace(F.regexp_replace("value", f"\\A{BOM}", ""), r"\A\s+|\s+\z", "")
    kept = lines.select("line_no", raw.alias("raw")).where(F.col("raw") != "")
    is_object = F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT")
    return once(kept, readable=F.coalesce(is_object, F.lit(False)))


def read_ndjson(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON objects, one a line: (row_no, raw) (S1). `strict` fails on the first other line."""
    lines = ndjson_lines(spark, path)
    if strict:
        bad = lines.where(~F.col("readable")).agg(F.min("line_no")).first()[0]
        if bad is not None:
            raise BadFile(f"line {bad} is not a JSON object")
    good = prepare(spark).read.text(path)
    raw = F.regexp_replace(F.regexp_replace("value", f"\\A{BOM}", ""), r"\A\s+|\s+\z", "")
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    return with_row_no(good.where(F.coalesce(is_object, F.lit(False)))).select("row_no", raw.alias("raw"))


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines a lenient reading skips."""
    return ndjson_lines(spark, path).agg(F.count_if(~F.col("readable")).alias("unreadable_lines"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Objects of one JSON array per file: (row_no, raw), the text of each object as it stands (S3).

    A file is read in splits, also when it is one line. Rows are numbered within their file; with several files they
    continue in path order.
    """
    array = splits.ArrayElements(spark, path)
    first = F.col("element") == 0
    begin = F.when(first, r"\A\s*\[\s*").otherwise(r"\A\s*,\s*")
    items = pin(array.elements.select("file", "element", F.regexp_like("text", begin).alias("begins"), F.regexp_replace("text", begin, "").alias("raw")))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    closing = F.when(first, r"\A\s*\[\s*\]\s*\z").otherwise(r"\A\s*\]\s*\z")
    wrong = items.where(~(F.col("begins") & is_object)).select("file", "element", F.lit(False).alias("at_end"))
    open_end = array.tails.where(~F.regexp_like("text", closing)).select("file", "element", F.lit(True).alias("at_end"))
    bad = wrong.unionByName(open_end).orderBy("file", "element").first()
    if bad is not None:
        raise BadFile(("the file is not a valid JSON array: " if bad["at_end"] else "") + f"item {bad['element'] + 1} is not a JSON object")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = items.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return items.join(offsets, "file").select((F.col("_offset") + F.col("element") + 1).alias("row_no"), "raw")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text cells with trimmed header names and `row_no` (S4). Short rows leave cells NULL, extra cells are dropped.

    Line breaks inside quotes belong to their cell; files are read in splits all the same. A quote in the wrong place or
    one that is never closed is an error that names the line. The header of the first file gives the names.
    """
    read = splits.CsvRecords(spark, path)
    error = read.error
    if error:
        raise BadFile(error)
    header = read.records.where("header").orderBy("record").first()
    if header is None:
        raise BadFile("the file is empty")
    names = [c.strip() for c in next(csv.reader(io.StringIO(header["text"], newline=""), skipinitialspace=True))]
    parsed = read.records.where("not header").select(F.col("record").alias("row_no"), splits.cells(F.col("text"), len(names)).alias("cells"))
    trimmed = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return once(parsed, kept=F.col("cells")).select("row_no", *[trimmed(F.col(f"kept.c{i}")).alias(name) for i, name in enumerate(unique(names))])


def unique(names: list[str]) -> list[str]:
    """Names as written; a repeated one gets a suffix so that the first keeps the name."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return out


def display_names(spark: SparkSession, path: str) -> DataFrame:
    """Short names of the files read, for display."""
    return spark.read.text(path).select(base_name(F.col("_metadata.file_path")).alias("name")).distinct()


# ---------------------------------------------------------------------------
# Request bodies
# ---------------------------------------------------------------------------
def _elements(text: Column, member: str | None = None) -> Column:
    """JSON texts of the elements of an array (or of the array under `member`), keys in their order.

    A string element would come back without its quotes and could pass for the JSON it spells; it is kept as an
    empty JSON string instead, which is refused like any other string.
    """
    texts = F.from_json(text, f"struct<{member}: array<string>>")[member] if member else F.from_json(text, "array<string>")
    path = f"$.{member}" if member else "$"
    values = F.try_variant_get(F.try_parse_json(text), path, "array<variant>")
    pick = lambda t, v: F.when(F.schema_of_variant(v) == "STRING", F.lit('""')).otherwise(F.coalesce(t, F.lit("null")))
    return F.zip_with(texts, values, pick)


def explode_payload(df: DataFrame, shape: str = "batch") -> DataFrame:
    """Records of request bodies with their position: (…, idx, raw).

    `shape` is batch ({"events":[…]}), array, ndjson or single.
    """
    kept = [c for c in df.columns if c != "body"]
    items = {
        "batch": lambda: _elements(F.col("body"), "events"),
        "array": lambda: _elements(F.col("body")),
        "ndjson": lambda: F.filter(F.split("body", "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s", "")) != ""),
        "single": lambda: F.array("body"),
    }[shape]()
    return df.select(*kept, F.posexplode(items).alias("idx", "raw"))


def batch_envelope(df: DataFrame, max_events: int = S.MAX_BATCH_EVENTS, max_bytes: int = S.MAX_BODY_BYTES) -> DataFrame:
    """What is wrong with each request as a whole: (…, n_events, status, error, detail); error is NULL for a good one.

    Text behind the object is found by wrapping the body in an array and in an object: what is fine inside both
    brackets is one value.
    """
    body = F.col("body")
    in_list = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), body, F.lit("}")))
    facts = once(
        df,
        _v=F.try_parse_json(body),
        _alone=F.coalesce(
            in_list.isNotNull() & in_object.isNotNull() & F.try_variant_get(in_list, "$[1]", "variant").isNull(), F.lit(False)
        ),
    )
    facts = once(
        facts,
        _kind=F.schema_of_variant("_v"),
        _events=F.schema_of_variant(F.try_variant_get("_v", "$.events", "variant")),
        n_events=F.coalesce(F.size(F.from_json("body", "struct<events: array<string>>")["events"]), F.lit(0)),
    )
    usable = F.col("_kind").startswith("OBJECT") & (
        F.col("_events").isNull() | (F.col("_events") == "VOID") | F.col("_events").startswith("ARRAY")
    )
    case = (
        F.when(F.octet_length("body") > max_bytes, "payload_too_large")
        .when(F.col("_kind") == "VOID", "empty_batch")
        .when(~F.coalesce(usable, F.lit(False)), "invalid_json")
        .when(~F.col("_alone"), "trailing_data")
        .when(F.greatest(F.col("n_events"), F.lit(0)) == 0, "empty_batch")
        .when(F.col("n_events") > max_events, "batch_too_large")
    )
    judged = once(facts, _case=case)
    details = F.create_map(*[F.lit(p) for pair in S.ENVELOPE_DETAILS.items() for p in pair])
    error = F.when(F.col("_case") == "trailing_data", "invalid_json").otherwise(F.col("_case"))
    return judged.select(
        *df.columns,
        F.greatest(F.col("n_events"), F.lit(0)).alias("n_events"),
        F.when(F.col("_case").isNull(), F.lit(None).cast("int"))
        .when(F.col("_case").isin("payload_too_large", "batch_too_large"), 413)
        .otherwise(400)
        .alias("status"),
        error.alias("error"),
        F.try_element_at(details, F.col("_case")).alias("detail"),
    )


def good_batches(enveloped: DataFrame) -> DataFrame:
    return enveloped.where(F.col("error").isNull()).drop("n_events", "status", "error", "detail")
