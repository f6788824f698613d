"""First-wins uniqueness under two keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse import schemas as S
from plantpulse.functions.skew import null_salt
from plantpulse.operators.validate import zero_filled
from plantpulse.session import pin

def first_accepted(
    df: DataFrame,
    id_cols: list[str],
    seq_cols: list[str],
    order_cols: list[str],
    outcome: str = "outcome",
) -> DataFrame:
    """Mark each row `accepted`, `repeated_id` or `repeated_sequence` as a scan in order would (D3).

    A row is accepted when no earlier accepted row has its id or its sequence key; a NULL in the sequence key
    conflicts with nothing; a refused row blocks nobody. Rows with one place in the order follow by id; of rows that
    agree in id and place, as when a request arrives twice, one is accepted and the others repeat its id.

    Rows that meet no other are accepted as they are; only the others go through the rounds. Each round accepts the rows that come first under both keys among the undecided ones and removes their
    neighbours, then decides chains of conflicts at once (`_chained`). Rows equal in both keys are collapsed first and the
    candidates are plain minima, so a key with a huge number of copies shrinks before any shuffle.
    """
    split = pin(_with_met(df, id_cols, seq_cols))
    alone = split.where("NOT _met").drop("_met").withColumn(outcome, F.lit("accepted"))
    return _in_rounds(split.where("_met").drop("_met"), id_cols, seq_cols, order_cols, outcome).unionByName(alone)


def _complete(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def _with_met(df: DataFrame, id_cols: list[str], seq_cols: list[str]) -> DataFrame:
    """Add `_met`: whether the row may share a key with another one.

    Keys are counted by 64-bit hashes: a hash that occurs once belongs to one row. Different keys of one hash are kept
    apart by the rounds, which compare the keys themselves.
    """
    by_id = F.xxhash64(F.lit(0), *id_cols)
    # A row without a sequence key looks its id up twice, so that such rows don't pile up in one task.
    by_seq = F.when(_complete(seq_cols), F.xxhash64(F.lit(1), *seq_cols))
    keys = df.select(F.explode(F.filter(F.array(by_id, by_seq), lambda k: k.isNotNull())).alias("_key"))
    shared = pin(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    sides = [shared.select(F.col("_key").alias(key), F.lit(True).alias(flag)) for key, flag in (("_by_id", "_id_met"), ("_by_seq", "_seq_met"))]
    keyed = df.withColumn("_by_id", by_id).withColumn("_by_seq", F.coalesce(by_seq, by_id))
    joined = keyed.join(sides[0], "_by_id", "left").join(sides[1], "_by_seq", "left")
    return joined.select(*df.columns, (F.col("_id_met").isNotNull() | F.col("_seq_met").isNotNull()).alias("_met"))


def _in_rounds(df: DataFrame, id_cols: list[str], seq_cols: list[str], order_cols: list[str], outcome: str) -> DataFrame:
    """The rows of `df` with their outcome, in rounds of plain minima."""
    keyed = df.select(
        F.struct(*id_cols).alias("_id"),
        F.when(_complete(seq_cols), F.struct(*seq_cols)).alias("_seq"),
        F.struct(*dict.fromkeys([*order_cols, *id_cols])).alias("_ord"),
    )
    undecided = keyed.groupBy("_id", "_seq").agg(F.min("_ord").alias("_ord"))
    winners: list[DataFrame] = []
    while True:
        for decide in (_first_under_both, _chained):
            # One written table per step: the winners, and the rows whose turn has not come.
            judged = pin(_judged(undecided, decide(undecided)).where("_open OR _won"))
            winners.append(judged.where("_won").select("_id", "_seq", "_ord"))
            undecided = judged.where("_open").select("_id", "_seq", "_ord")
            if undecided.isEmpty():
                return _marked(df, winners, id_cols, seq_cols, order_cols, outcome)


def _marked(df: DataFrame, winners: list[DataFrame], id_cols: list[str], seq_cols: list[str], order_cols: list[str], outcome: str) -> DataFrame:
    """Every row with its outcome, given the accepted ones."""
    first = reduce(DataFrame.unionByName, [w.select("_id", F.col("_ord").alias("_first")) for w in winners])
    marked = df.withColumn("_id", F.struct(*id_cols)).join(first, "_id", "left")
    here = F.struct(*dict.fromkeys([*order_cols, *id_cols]))
    place = list(dict.fromkeys([*id_cols, *order_cols]))
    single = F.lit(True)
    if not df.groupBy(*place).count().where("count > 1").isEmpty():
        # A request that arrived twice: only then rows are numbered inside their place.
        marked = marked.withColumn("_copy", F.row_number().over(Window.partitionBy(*place).orderBy(*seq_cols)))
        single = F.col("_copy") == 1
    judged = marked.withColumn(
        outcome,
        F.when((F.col("_first") == here) & single, F.lit("accepted"))
        .when(F.col("_first") <= here, F.lit("repeated_id"))
        .otherwise(F.lit("repeated_sequence")),
    )
    return judged.drop("_id", "_first", "_copy")


def _judged(undecided: DataFrame, won: DataFrame) -> DataFrame:
    """Add `_won` and `_open` (neither winner nor neighbour of one) for the given winners."""
    ids = won.select("_id", F.col("_ord").alias("_by_id"), F.col("_seq").alias("_with"))
    seqs = won.where(F.col("_seq").isNotNull()).select("_seq", F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias("_by_seq"))
    salted = undecided.withColumn("_salt", null_salt(F.col("_seq").isNull(), "_id"))
    joined = salted.join(ids, "_id", "left").join(seqs, ["_seq", "_salt"], "left")
    return joined.select(
        "_id",
        "_seq",
        "_ord",
        (F.col("_by_id").eqNullSafe(F.col("_ord")) & F.col("_with").eqNullSafe(F.col("_seq"))).alias("_won"),
        (F.col("_by_id").isNull() & F.col("_by_seq").isNull()).alias("_open"),
    )


def _first_under_both(undecided: DataFrame) -> DataFrame:
    by_id = (
        undecided.groupBy("_id")
        .agg(F.min(F.struct("_ord", "_seq")).alias("_m"))
        .select("_id", F.col("_m._seq").alias("_seq"), F.col("_m._ord").alias("_ord"))
    )
    # No filter on NULL keys here: it would sink below the collapse and keep the two sides from sharing its shuffle.
    by_seq = undecided.groupBy("_seq").agg(F.min("_ord").alias("_ord"))
    free = by_id.where(F.col("_seq").isNull())
    return by_id.join(by_seq, ["_seq", "_ord"], "left_semi").select("_id", "_seq", "_ord").unionByName(free)


def _first_two(undecided: DataFrame, key: str) -> DataFrame:
    """Per key its first row `_one` and, where there is a further one, its second `_two`."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("_row"))
    # Spark cuts each task to two rows a key before the shuffle.
    few = undecided.where(F.col(key).isNotNull()).withColumn("_place", place).where("_place <= 2")
    return few.groupBy(key).agg(F.min("_row").alias("_one"), F.max("_row").alias("_two"))


def _chained(undecided: DataFrame) -> DataFrame:
    """The accepted rows among those that a chain of single conflicts leads back to a first row.

    A row with one earlier undecided neighbour is accepted exactly when that one is not, so it takes the opposite of what
    its neighbour gets. Links are followed in powers of two, the number of turns counted along: a chain of n rows takes
    log2(n) joins, and no task holds it. Rows behind one with several earlier neighbours wait.
    """
    rows = undecided.withColumn("_row", F.struct("_ord", "_seq"))
    salted = rows.withColumn("_salt", null_salt(F.col("_seq").isNull(), "_id"))
    by_id = _first_two(rows, "_id")
    by_seq = _first_two(rows, "_seq").select("_seq", F.lit(0).cast("bigint").alias("_salt"), F.col("_one").alias("_one_s"), F.col("_two").alias("_two_s"))
    met = salted.join(by_id, "_id").join(by_seq, ["_seq", "_salt"], "left")

    def earlier(one: str, two: str) -> Column:
        return F.when(F.col(one).isNull() | (F.col("_row") == F.col(one)), 0).when(F.col("_row") == F.col(two), 1).otherwise(2)

    counted = met.withColumn("_e", earlier("_one", "_two")).withColumn("_s", earlier("_one_s", "_two_s"))
    before = F.when(F.col("_e") + F.col("_s") == 1, F.when(F.col("_e") == 1, F.col("_one")).otherwise(F.col("_one_s")))
    # `_to` is where the links followed so far lead, NULL at a row that has none to follow.
    links = pin(counted.select("_id", "_seq", "_ord", "_row", before.alias("_to"), (F.col("_e") + F.col("_s") == 0).alias("_free"), F.lit(False).alias("_turned")))
    ended = links.where("_to IS NULL").select("_row", "_free", "_turned")
    active = links.where("_to IS NOT NULL").select("_row", "_to", F.lit(True).alias("_turned"))
    done = [ended]
    while not active.isEmpty():
        at = ended.select(F.col("_row").alias("_to"), F.col("_free").alias("_end"), F.col("_turned").alias("_end_turned"))
        on = active.select(F.col("_row").alias("_to"), F.col("_to").alias("_next"), F.col("_turned").alias("_next_turned"))
        step = active.join(at, "_to", "left").join(on, "_to", "left")
        turned = F.col("_turned") != F.coalesce("_end_turned", "_next_turned")
        step = pin(step.select("_row", F.when(F.col("_end").isNull(), F.col("_next")).alias("_to"), F.col("_end").alias("_free"), turned.alias("_turned")))
        done.append(step.where("_to IS NULL").select("_row", "_free", "_turned"))
        ended = reduce(DataFrame.unionByName, done)
        active = step.where("_to IS NOT NULL").select("_row", "_to", "_turned")
    accepted = ended.where("_free AND NOT _turned").select("_row")
    return links.join(accepted, "_row", "left_semi").select("_id", "_seq", "_ord")


def dedup_in_batch(checked: DataFrame, batch: str = "batch_id", idx: str = "idx") -> DataFrame:
    """Add `duplicate_in_batch` to the reasons of already checked rows."""
    checked = pin(checked)
    bad = checked.where(F.col("reason").isNotNull())
    good = first_accepted(
        checked.where(F.col("reason").isNull()),
        [batch, "event_id"],
        [batch, "device_id", "sequence"],
        [batch, idx],
    )
    detail = F.when(F.col("outcome") == "repeated_id", F.lit(S.DETAIL_REPEATED_ID)).when(
        F.col("outcome") == "repeated_sequence", F.lit(S.DETAIL_REPEATED_SEQUENCE)
    )
    judged = good.withColumn("detail", detail).withColumn(
        "reason", F.when(F.col("detail").isNotNull(), F.lit("duplicate_in_batch"))
    )
    return bad.unionByName(judged.select(*bad.columns))


def insert_new(df: DataFrame, existing: DataFrame | None, order_cols: list[str]) -> DataFrame:
    """Outcome `stored` or `duplicate` per row against the store and within the rows themselves.

    The store is read for its key columns only and reduced to the keys that arrive before it is joined back. `df` is
    read more than once, so hand in a table rather than a long computation.
    """
    fresh = df
    known = None
    if existing is not None:
        ids = existing.select("event_id").join(df.select("event_id"), "event_id", "left_semi").distinct()
        pairs = (
            existing.select("device_id", "sequence")
            .where(F.col("sequence").isNotNull())
            .join(df.select("device_id", "sequence"), ["device_id", "sequence"], "left_semi")
            .distinct()
        )
        pairs = pairs.select("*", F.lit(0).cast("bigint").alias("_salt"), F.lit(True).alias("_has_seq"))
        flagged = pin(
            df.withColumn("_salt", null_salt(F.col("sequence").isNull(), "event_id"))
            .join(ids.withColumn("_has_id", F.lit(True)), "event_id", "left")
            .join(pairs, ["device_id", "sequence", "_salt"], "left")
        )
        seen = F.col("_has_id").isNotNull() | F.col("_has_seq").isNotNull()
        known = flagged.where(seen).select(*df.columns).withColumn("outcome", F.lit("duplicate"))
        fresh = flagged.where(~seen).select(*df.columns)
    judged = first_accepted(fresh, ["event_id"], ["device_id", "sequence"], order_cols)
    judged = judged.withColumn(
        "outcome", F.when(F.col("outcome") == "accepted", F.lit("stored")).otherwise(F.lit("duplicate"))
    ).select(*df.columns, "outcome")
    return judged if known is None else judged.unionByName(known)


def stored_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "stored").drop("outcome")


def persist_outcomes(outcomes: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Stored and duplicate rows per batch (D4). A failed write has no rows here; see the metrics operators."""
    return outcomes.groupBy(batch).agg(
        F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def processed_outcomes(outcomes: DataFrame) -> DataFrame:
    """Rows per processing outcome over everything, zero-filled (M2)."""
    return zero_filled(outcomes.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", S.PROCESSED_OUTCOMES)
