"""Exports of every matching row in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.text import plain_number
from plantpulse.functions.times import format_nano
from plantpulse.operators.store import IDS, Query, pages, selected

COLUMNS = {"events": S.EVENT_EXPORT_COLUMNS, "alerts": S.ALERT_EXPORT_COLUMNS}
OBJECTS = {
    "events": ["schema_version", "event_id", "device_id", "event_time", "received_at", "sequence", "temperature_c", "vibration_mm_s", "site_id"],
    "alerts": ["alert_id", "device_id", "event_id", "rule", "threshold", "observed", "event_time", "created_at"],
}
TIMES = {"event_time", "received_at", "created_at"}
NUMBERS = {"temperature_c", "vibration_mm_s", "threshold", "observed"}


def _cell(name: str) -> Column:
    c = F.col(name)
    text = format_nano(c) if name in TIMES else plain_number(c) if name in NUMBERS else c.cast("string")
    return F.coalesce(text, F.lit("")).alias(name)


def csv_rows(df: DataFrame, q: Query, kind: str = "events") -> DataFrame:
    """Text cells under the fixed headers; a missing value is an empty cell."""
    t, row_id = "event_time", IDS[kind]
    ordered = selected(df, q).orderBy(t, row_id)
    return ordered.select(*[_cell(c) for c in COLUMNS[kind]])


def object_text(kind: str) -> Column:
    """One JSON object; an absent sequence or site is left out."""
    value = {c: F.col(c) for c in OBJECTS[kind]}
    for c in TIMES & value.keys():
        value[c] = format_nano(F.col(c))
    if "site_id" in value:
        value["site_id"] = F.nullif(F.col("site_id"), F.lit(""))
    return F.to_json(F.struct(*[v.alias(n) for n, v in value.items()]))


def ndjson_rows(df: DataFrame, q: Query, kind: str = "events") -> DataFrame:
    return selected(df, q).orderBy("event_time", IDS[kind]).select(object_text(kind).alias("value"))


def json_pages(df: DataFrame, q: Query, kind: str = "events", rows: int = S.EXPORT_PAGE_ROWS) -> DataFrame:
    """JSON arrays of at most `rows` objects each, numbered in key order: (page, value).

    One array of everything would have to pass through one task; the page size bounds each of these.
    """
    cut = Query(q.start, q.end, q.device_id, rows)
    numbered = pages(df, cut, kind)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_time", IDS[kind], "_o"))), lambda x: x["_o"]), ",")
    return (
        numbered.withColumn("_o", object_text(kind))
        .groupBy("page")
        .agg(F.concat(F.lit("["), text, F.lit("]")).alias("value"))
    )


def export_csv(df: DataFrame, q: Query, path: str, kind: str = "events") -> None:
    """Files in key order (part files sort by name), each with the header."""
    csv_rows(df, q, kind).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def export_ndjson(df: DataFrame, q: Query, path: str, kind: str = "events") -> None:
    """One object a line, files in key order."""
    ndjson_rows(df, q, kind).write.mode("errorifexists").text(path)


def export_json_array(df: DataFrame, q: Query, path: str, kind: str = "events") -> None:
    """One JSON array per line and page, in page order."""
    json_pages(df, q, kind).orderBy("page").select("value").write.mode("errorifexists").text(path)
