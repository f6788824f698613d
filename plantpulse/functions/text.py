"""Identifiers, labels and clean texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantpulse.functions.numbers import fixed_text
from plantpulse.schemas import ID_RULE, REASON_LABELS


def is_identifier(text: Column) -> Column:
    """Whole-text match; `$` would let a trailing newline through."""
    return text.rlike(rf"\A{ID_RULE}\z")


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def plain_number(value: Column) -> Column:
    """Shortest decimal text of a double without an exponent: 85.0 -> 85, 1.0E-5 -> 0.00001."""
    text = value.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    negative = mantissa.startswith("-")
    digits = F.regexp_replace(mantissa, "[-.]", "")
    point = F.length(F.substring_index(F.regexp_replace(mantissa, "-", ""), ".", 1)) + exponent
    expanded = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, F.length(digits))))
    )
    signed = F.when(text.contains("E"), F.concat(F.when(negative, "-").otherwise(""), expanded)).otherwise(text)
    return F.when(signed.contains("."), F.regexp_replace(signed, r"\.?0+$", "")).otherwise(signed)


def reason_label(reason: Column) -> Column:
    """Everyday words for a reason; an unknown one is shown in brackets without underscores."""
    labels = F.create_map(*[F.lit(part) for pair in REASON_LABELS.items() for part in pair])
    fallback = F.concat(F.lit("("), F.translate(reason, "_", " "), F.lit(")"))
    return F.coalesce(F.try_element_at(labels, reason), fallback)


def human_seconds(seconds: Column) -> Column:
    return (
        F.when(seconds < 90, F.concat(fixed_text(seconds, 0), F.lit(" s")))
        .when(seconds < 5400, F.concat(fixed_text(seconds / 60, 1), F.lit(" min")))
        .otherwise(F.concat(fixed_text(seconds / 3600, 1), F.lit(" h")))
    )


def counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def clean_excerpt(text: Column, n: int) -> Column:
    """First n characters on one line: control characters become spaces, runs of spaces collapse."""
    line = F.regexp_replace(F.substring(text, 1, n), r"[\x00-\x1f\x7f�]", " ")
    line = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(F.length(text) > n, F.concat(line, F.lit("…"))).otherwise(line)


def display_address(url: Column) -> Column:
    """scheme://host[:port] only: path, query, fragment and credentials may hold secrets."""
    scheme = F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))
    host = F.regexp_replace(F.try_parse_url(F.trim(url), F.lit("AUTHORITY")), "^.*@", "")
    return F.coalesce(F.concat(scheme, F.lit("://"), host), F.lit(""))


def saved_address(url: Column) -> Column:
    """Address kept in a saved setup: path stays, query, fragment and credentials go."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/]*@", "$1")


def hide_header_values(headers: Column) -> Column:
    return F.transform_values(headers, lambda _name, _value: F.lit("(hidden)"))


def base_name(path: Column) -> Column:
    """Short printable file name for display."""
    name = F.regexp_replace(F.regexp_extract(F.trim(path), r"([^/\\]*)\z", 1), r"[\x00-\x1f\x7f]", "")
    return F.when(name == "", F.lit("imported file")).otherwise(F.substring(name, 1, 80))


def table_cell(text: Column) -> Column:
    """Text inside a markdown table cell."""
    return F.translate(F.regexp_replace(text, r"\|", r"\\|"), "\n", " ")
