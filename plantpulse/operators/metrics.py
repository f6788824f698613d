"""Service counters and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.text import plain_number
from plantpulse.operators.ordered import InOrder, carry_forward
from plantpulse.operators.validate import zero_filled
from plantpulse.session import once, pin


def ingest_outcomes(attempts: DataFrame) -> DataFrame:
    """Records per intake outcome, a retried batch counted again (M1)."""
    ack = lambda c: F.when(F.col("is_ack"), F.coalesce(c, F.lit(0))).otherwise(0)
    valid = F.col("n_records") - ack("ack_rejected")
    answered = F.col("status").isin(202, 429, 503)
    sums = F.array(
        F.struct(F.lit("accepted").alias("outcome"), F.when(F.col("status") == 202, ack("ack_accepted")).alias("n")),
        F.struct(F.lit("rejected_invalid").alias("outcome"), F.when(answered, ack("ack_rejected")).alias("n")),
        F.struct(F.lit("rejected_overload").alias("outcome"), F.when(F.col("status") == 429, valid).alias("n")),
        F.struct(F.lit("rejected_shutdown").alias("outcome"), F.when(F.col("status") == 503, valid).alias("n")),
    )
    counts = attempts.select(F.inline(sums)).groupBy("outcome").agg(F.sum("n").alias("n"))
    return zero_filled(counts, "outcome", S.INGEST_OUTCOMES)


def failure_stages(failures: DataFrame) -> DataFrame:
    """Failures per stage, zero-filled (M2); `failures` has one row per failure with its `stage`."""
    return zero_filled(failures.groupBy("stage").agg(F.count("*").alias("n")), "stage", S.FAILURE_STAGES)


def source_lag(events: DataFrame) -> DataFrame:
    """Seconds from source time to arrival; negative when the source clock is ahead (M5)."""
    return events.withColumn("lag_s", (F.unix_micros("received_at") - F.unix_micros("event_time")) / 1e6)


def durations(log: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Seconds between two log times (M6: queue wait, processing duration)."""
    return log.withColumn(out, (F.unix_micros(end) - F.unix_micros(start)) / 1e6)


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative counts per upper bound, with total count and sum (M3).

    Values are reduced to one row per group and bucket before the shuffle; the running sum goes over those.
    """
    by = by or []
    v = F.col(value)
    bucket = reduce(lambda c, ib: c.when(v <= ib[1], ib[0]), list(enumerate(bounds))[1:], F.when(v <= bounds[0], 0)).otherwise(len(bounds))
    counts = df.where(v.isNotNull()).groupBy(*by, bucket.alias("_b")).agg(F.count("*").alias("_n"), F.sum(v).alias("_s"))
    labels = [F.struct(F.lit(i).alias("_b"), plain_number(F.lit(float(b))).alias("le")) for i, b in enumerate(bounds)]
    labels.append(F.struct(F.lit(len(bounds)).alias("_b"), F.lit("+Inf").alias("le")))
    if by:
        groups = counts.select(*by).distinct()
    else:
        groups = df.sparkSession.range(1).select()
    grid = groups.select(*by, F.inline(F.array(*labels)))
    up_to = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b")
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    return grid.join(counts, [*by, "_b"], "left").select(
        *by,
        F.col("_b").alias("bucket"),
        "le",
        F.sum(F.coalesce("_n", F.lit(0))).over(up_to).alias("cumulative"),
        F.sum(F.coalesce("_n", F.lit(0))).over(whole).alias("count"),
        F.coalesce(F.sum("_s").over(whole), F.lit(0.0)).alias("total"),
    )


def histogram_quantile(hist: DataFrame, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket (M4); beyond the last bound, that bound."""
    by = by or []
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket")
    upper = F.col("le").try_cast("double")
    edges = hist.withColumn("_upper", F.when(F.col("le") != "+Inf", upper)).select(
        *by,
        "bucket",
        "cumulative",
        "count",
        "_upper",
        F.coalesce(F.lag("_upper").over(order), F.lit(0.0)).alias("_lower"),
        F.coalesce(F.lag("cumulative").over(order), F.lit(0)).alias("_before"),
    )
    asked = edges.where(F.col("count") > 0).select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    rank = F.col("q") * F.col("count")
    hit = asked.where((F.col("cumulative") >= rank)).groupBy(*by, "q").agg(
        F.min_by(F.struct("_upper", "_lower", "_before", "cumulative", "count"), "bucket").alias("b")
    )
    b = lambda c: F.col(f"b.{c}")
    inside = b("_lower") + (b("_upper") - b("_lower")) * (F.col("q") * b("count") - b("_before")) / F.nullif(
        b("cumulative") - b("_before"), F.lit(0)
    )
    return hit.select(
        *by, "q", F.when(b("_upper").isNull(), b("_lower")).otherwise(F.coalesce(inside, b("_upper"))).alias("value")
    )


def request_counts(accesses: DataFrame) -> DataFrame:
    """Requests per route and code (M7)."""
    return accesses.groupBy("route", "code").agg(F.count("*").alias("n"))


def request_latency(accesses: DataFrame, live_route: str = "/ws") -> DataFrame:
    """Latency histogram per route; the long-lived live route is left out (M7)."""
    return histogram(accesses.where(F.col("route") != live_route), "seconds", S.LATENCY_BOUNDS, ["route"])


def sample_values(lines: DataFrame) -> DataFrame:
    """Metric text lines as (name, labels, value); a name ends at a space or a brace."""
    line = F.col("line")
    name = F.regexp_extract(line, r"\A([^ {#]+)[ {]", 1)
    labels = F.regexp_extract(line, r"\A[^ {]+\{(.*)\}", 1)
    # Taken apart once: filters on the name and the series would otherwise repeat the patterns for each comparison.
    apart = once(lines.drop("name", "labels", "value"), name=name, labels=labels, value=F.substring_index(line, " ", -1).try_cast("double"))
    return apart.where(F.col("name") != "").drop("line")


def sample_sum(samples: DataFrame, name: str, label: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Sum of the samples of a name whose labels contain `label`; NULL when there are none."""
    kept = samples.where(F.col("name") == name)
    if label:
        kept = kept.where(F.col("labels").contains(label))
    return kept.groupBy(*(by or [])).agg(F.sum("value").alias("value"))


def _series(prefix: str) -> Column:
    """Column of the series a sample belongs to."""
    known = {f"{prefix}_queue_depth": [("queue_depth", "")]}
    known[f"{prefix}_ingest_events_total"] = [(o, f'outcome="{o}"') for o in S.INGEST_OUTCOMES[:3]]
    known[f"{prefix}_processed_events_total"] = [(o, f'outcome="{o}"') for o in S.PROCESSED_OUTCOMES]
    pairs = [(n, column, label) for n, columns in known.items() for column, label in columns]
    test = lambda n, label: (F.col("name") == n) & F.col("labels").contains(label)
    first = F.when(test(pairs[0][0], pairs[0][2]), pairs[0][1])
    return reduce(lambda c, p: c.when(test(p[0], p[2]), p[1]), pairs[1:], first)


def scrape_long(lines: DataFrame, prefix: str = "pulse") -> DataFrame:
    """(t, metric, value) of the known series, summed per sample time."""
    return (
        sample_values(lines)
        .withColumn("metric", _series(prefix))
        .where(F.col("metric").isNotNull())
        .groupBy("t", "metric")
        .agg(F.sum("value").alias("value"))
    )


def scrape_series(lines: DataFrame, prefix: str = "pulse") -> DataFrame:
    """One row per sample time with the seven series as columns (M9)."""
    named = sample_values(lines).withColumn("metric", _series(prefix)).where(F.col("metric").isNotNull())
    return named.groupBy("t").pivot("metric", S.SCRAPE_COLUMNS).agg(F.sum("value").cast("bigint"))


def counter_deltas(series: DataFrame, pieces: int | None = None) -> DataFrame:
    """Growth of each counter since its previous sample (M8). A metric may have any number of samples."""
    lagged = InOrder(series, ["metric"], ["t"], pieces).lag(F.col("value"), "_before")
    return lagged.select("metric", "t", "value", (F.col("value") - F.col("_before")).alias("delta"))


def growth_between(series: DataFrame, spans: DataFrame) -> DataFrame:
    """`growth` of a counter over each span (M8): its samples (t, value) as of `to_t` less those as of `from_t`.

    A value below the one before means that the counter began anew, and counts in full. A span that begins before the
    first sample counts from that one; one that ends before it has no growth (NULL).
    """
    lagged = InOrder(series.select("t", "value"), [], ["t"]).lag(F.col("value"), "_before")
    step = F.when(F.col("_before").isNull(), 0.0).when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).otherwise(F.col("value"))
    total = InOrder(lagged.select("t", step.alias("_step")), [], ["t"]).running_sum(F.col("_step"), "_total").select("t", "_total")
    asked = spans.select(F.explode(F.array("from_t", "to_t")).alias("asked")).distinct()
    known = pin(metrics_as_of(asked, total).select("asked", "_total"))
    ends = [known.select(F.col("asked").alias(t), F.col("_total").alias(f"_{t}")) for t in ("from_t", "to_t")]
    growth = F.col("_to_t") - F.coalesce("_from_t", F.lit(0.0))
    return spans.join(ends[0], "from_t").join(ends[1], "to_t").select(*spans.columns, growth.alias("growth"))


def metrics_as_of(asked: DataFrame, series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each asked time the last sample at or before it, NULL when there is none.

    Both sides are merged in time order and the last sample is carried along, so no pair of rows is formed.
    """
    by = by or []
    values = [c for c in series.columns if c not in (*by, "t")]
    samples = series.select(*by, "t", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_n"), F.struct("t", *values).alias("_s"))
    kind = samples.schema["_s"].dataType
    times = asked.select(
        *by, F.col("asked").alias("t"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_n"), F.lit(None).cast(kind).alias("_s")
    )
    merged = carry_forward(samples.unionByName(times), by, ["t", "_side", "_n"], "_s", "_last")
    return merged.where(F.col("_side") == 1).select(
        *by, F.col("t").alias("asked"), F.col("_last.t").alias("sample_t"), *[F.col(f"_last.{v}").alias(v) for v in values]
    )
