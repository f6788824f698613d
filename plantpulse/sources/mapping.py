"""Columns of an imported file onto the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.numbers import is_finite
from plantpulse.functions.text import blank_to_null
from plantpulse.functions.times import format_ms, parse_rfc3339
from plantpulse.operators.validate import INTEGER_FIELDS, NUMBER_FIELDS, check_records
from plantpulse.schemas import Limits
from plantpulse.session import once
from plantpulse.sources.readers import BOM, BadFile, detect_format, read_csv, read_json_array, read_ndjson

MAX_COLUMNS = 10_000

ALIAS_OF = {alias: name for name, words in S.COLUMN_ALIASES.items() for alias in words}


def plain_name(column: str) -> str:
    """Lower case without byte mark and outer blanks; spaces and dashes as underscores."""
    return column.removeprefix(BOM).strip().lower().translate(str.maketrans(" -", "__"))


@dataclass
class ColumnPlan:
    """Which column feeds which field."""

    columns: list[str]
    fields: dict[str, str] = field(default_factory=dict)  # field -> column
    mapped: dict[str, str] = field(default_factory=dict)  # column -> field, when the names differ
    ignored: list[str] = field(default_factory=list)

    @property
    def derived(self) -> list[str]:
        notes = {"event_id": "event_id (device id and row number)", "schema_version": "schema_version (1)"}
        return [note for name, note in notes.items() if name not in self.fields]


class NeedsMapping(ValueError):
    """Required fields have no column: the user has to say which one feeds them."""

    def __init__(self, missing: list[str], columns: list[str], found: dict[str, str]):
        self.missing, self.columns, self.found = missing, columns, found
        super().__init__(f"the file has no column for {', '.join(missing)}")


def resolve_mapping(columns: list[str], override: dict[str, str] | None = None) -> ColumnPlan:
    """Plan for a header (P2). `override` maps a column to a field, or to '' to leave it out.

    The user's choices come first, then exact names, then everyday names for fields without an exact column. A
    field is fed by its first column only.
    """
    plan = ColumnPlan(list(columns))
    shown = {c: c.strip() for c in columns}
    choices = {name.strip(): target for name, target in (override or {}).items()}
    for name in sorted(choices):
        target = choices[name]
        if name not in shown.values():
            raise ValueError(f'the file has no column named "{name}"')
        if target and target not in S.SCHEMA_FIELDS:
            raise ValueError(f'"{target}" is not a field of the schema')
        if target in plan.fields:
            raise ValueError(f"two columns are mapped to {target}; choose one column for each field")
        if not target:
            plan.ignored.append(name)
            continue
        plan.fields[target] = next(c for c in columns if shown[c] == name)
        if plain_name(name) != target:
            plan.mapped[name] = target
    exact = {plain_name(c) for c in columns} & set(S.SCHEMA_FIELDS)
    decided: set[str] = set()
    for column in columns:
        name = shown[column]
        if name in choices and name not in decided:
            decided.add(name)  # a choice speaks for the first column of that name
            continue
        plain = plain_name(column)
        target = plain if plain in exact else ALIAS_OF.get(plain)
        if target is None or target in plan.fields or (target != plain and target in exact):
            plan.ignored.append(name)
            continue
        plan.fields[target] = column
        if target != plain:
            plan.mapped[name] = target
    return plan


def require_mapping(plan: ColumnPlan) -> ColumnPlan:
    """Refuse a plan that leaves a required field without a column."""
    missing = [f for f in S.REQUIRED_IMPORT_FIELDS if f not in plan.fields]
    if missing:
        raise NeedsMapping(missing, plan.columns, dict(plan.fields))
    return plan


# Shapes of numbers a CSV cell may have; a cast alone would also take a trailing letter.
DECIMAL_TEXT = r"\A[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\z"
INTEGER_TEXT = r"\A[+-]?\d+\z"


def _cells(df: DataFrame, plan: ColumnPlan) -> DataFrame:
    """CSV cells as typed columns (P4): an unreadable number stays visible as a wrong type in `shape`."""
    cell = {f: blank_to_null(F.col(f"`{c}`")) for f, c in plan.fields.items()}
    numbers = {
        **{f: (cell[f], F.when(F.lower(cell[f]).rlike(DECIMAL_TEXT), cell[f].try_cast("double"))) for f in NUMBER_FIELDS if f in cell},
        **{f: (cell[f], F.when(cell[f].rlike(INTEGER_TEXT), cell[f].try_cast("bigint"))) for f in INTEGER_FIELDS if f in cell},
    }
    wrong = [
        F.when(text.isNotNull() & value.isNull(), F.lit(f)) for f, (text, value) in sorted(numbers.items())
    ]
    endless = [F.when(value.isNotNull() & ~is_finite(value), F.lit("?")) for f, (_, value) in numbers.items() if f in NUMBER_FIELDS]
    values = {f: numbers[f][1] if f in numbers else cell[f] for f in cell}
    return _filled(df, plan, values, F.coalesce(*endless, *wrong, F.lit(None).cast("string")))


def _members(df: DataFrame, plan: ColumnPlan) -> DataFrame:
    """Members of JSON objects as typed columns; a member of another type shows up in `shape`."""
    path = {f: "$['" + c.replace("\\", "\\\\").replace("'", "\\'") + "']" for f, c in plan.fields.items()}
    decoded = df.withColumn("_v", F.try_parse_json("raw"))
    parts = {}
    for f, p in path.items():
        parts[f"_{f}_type"] = F.schema_of_variant(F.try_variant_get("_v", p, "variant"))
        parts[f"_{f}_text"] = F.try_variant_get("_v", p, "string")
        if f in NUMBER_FIELDS:
            parts[f"_{f}_value"] = F.try_variant_get("_v", p, "double")
    split = once(decoded, **parts)
    values, wrong = {}, []
    for f in path:
        kind, text = F.col(f"_{f}_type"), F.col(f"_{f}_text")
        given = kind.isNotNull() & (kind != "VOID") & ~((kind == "STRING") & (F.trim(text) == ""))
        if f in NUMBER_FIELDS:
            fits = kind.rlike(r"\A(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))\z") & is_finite(F.col(f"_{f}_value"))
            values[f] = F.when(fits, F.col(f"_{f}_value"))
        elif f in INTEGER_FIELDS:
            fits = kind == "BIGINT"
            values[f] = F.when(fits, text.try_cast("bigint"))
        else:
            fits = (kind == "STRING") | F.lit(f == "event_time")
            values[f] = F.when(fits & given, text)
        wrong.append((f, F.when(given & ~fits, F.lit(f))))
    shape = F.coalesce(*[w for _, w in sorted(wrong, key=lambda x: x[0])], F.lit(None).cast("string"))
    return _filled(split, plan, values, shape)


def _filled(df: DataFrame, plan: ColumnPlan, values: dict[str, Column], shape: Column) -> DataFrame:
    """All schema fields, with the derived ones filled in (P5)."""
    types = {**{f: "double" for f in NUMBER_FIELDS}, **{f: "bigint" for f in INTEGER_FIELDS}}
    typed = once(
        df,
        **{f"f_{f}": values.get(f, F.lit(None)).cast(types.get(f, "string")) for f in S.SCHEMA_FIELDS},
        shape=shape,
    )
    made_up = F.concat(F.coalesce("f_device_id", F.lit("")), F.lit("-"), F.col("row_no").cast("string"))
    event_id = F.col("f_event_id") if "event_id" in plan.fields else made_up
    version = F.when(F.col("f_schema_version").isNull() & ~F.col("shape").eqNullSafe("schema_version"), 1).otherwise(F.col("f_schema_version"))
    filled = {"event_id": event_id, "schema_version": version.cast("bigint"), "event_time": F.coalesce("f_event_time", F.lit(""))}
    return typed.select("row_no", *[filled.get(f, F.col(f"f_{f}")).alias(f) for f in S.SCHEMA_FIELDS], "shape")


def object_columns(df: DataFrame) -> list[str]:
    """Keys of all objects by first appearance, those of one object by name. One row per key reaches the driver; a
    file whose keys are data and not names is refused."""
    keys = df.select("row_no", F.explode(F.json_object_keys("raw")).alias("key"))
    first = keys.groupBy("key").agg(F.min("row_no").alias("row_no"))
    found = first.orderBy("row_no", "key").limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise BadFile(f"the file has more than {MAX_COLUMNS} different column names")
    return [r["key"] for r in found]


@dataclass
class Imported:
    """An imported recording: typed rows as the report wants them, and how they came about."""

    format: str
    plan: ColumnPlan
    rows: DataFrame

    @property
    def derived_ids(self) -> bool:
        return "event_id" not in self.plan.fields

    def checked(self, now: Column, limits: Limits = Limits()) -> DataFrame:
        return check_records(self.rows.withColumn("received_at", now), limits)


def import_file(spark: SparkSession, path: str, override: dict[str, str] | None = None, fmt: str | None = None) -> Imported:
    """Read a CSV, NDJSON or JSON-array recording and map its columns."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "csv":
        table = read_csv(spark, path)
        plan = require_mapping(resolve_mapping([c for c in table.columns if c != "row_no"], override))
        rows = _cells(table, plan)
    else:
        table = read_json_array(spark, path) if fmt == "json" else read_ndjson(spark, path, strict=True)
        plan = resolve_mapping(object_columns(table), override)
        rows = _members(table, require_mapping(plan)) if plan.columns else _members(table, plan)
    if not table.take(1):
        raise BadFile("the file has a header but no rows")
    return Imported(fmt, plan, rows)


def dataset_summary(imported: Imported, checked: DataFrame) -> DataFrame:
    """One row about the import (P6); rejected rows by reason come from `rejection_counts`."""
    t = parse_rfc3339(F.col("event_time"))
    plan = imported.plan
    words = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    per_device = imported.rows.groupBy("device_id").agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    facts = per_device.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("device_id").alias("devices"),
        format_ms(F.min("first")).alias("first_time"),
        format_ms(F.max("last")).alias("last_time"),
    )
    problems = checked.agg(F.count_if(F.col("reason").isNotNull()).alias("n"))
    return facts.select(
        F.lit(imported.format).alias("format"),
        "rows",
        "devices",
        words(plan.columns).alias("columns"),
        words([f"{c}={f}" for c, f in plan.mapped.items()]).alias("mapped"),
        words(plan.ignored).alias("ignored"),
        words(plan.derived).alias("derived"),
        "first_time",
        "last_time",
        problems.scalar().alias("problems"),
    )
