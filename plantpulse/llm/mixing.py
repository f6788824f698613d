"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.common import restored, shielded, spread_key, word_array
from plantpulse.session import pin

#: Rows that agree in these are the same document.
DOC_COLUMNS = ("doc_id", "source", "text")
WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
BLOCK_WORDS = 128
#: Points are multiples of 2^-32: slot times GOLDEN modulo 2^32, with GOLDEN = 2^32 / golden ratio^2 rounded to an odd number.
GOLDEN = 1_640_531_527
POINTS = 2**32
#: Sources and slots meet in these buckets of the unit interval.
POINT_BUCKETS = 4096
#: Pieces of a source's shuffled stream that are summed up separately.
STREAM_BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT) -> DataFrame:
    """`_source, source, source_size, target` from rows with `source` and `_size`.

    Sources in code-point order, null last, take the weights in turn. All targets together are `percent` of all sizes;
    none is above MAX_EPOCHS times its source. What a full source can't take goes to the others by weight: with the
    sources in order of the level at which they are full, the level of the rest is what remains over the weight left.
    The table has a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("_w", F.get(F.array(*map(F.lit, weights)), turn).cast("bigint"))
    per = per.withColumn("_cap", MAX_EPOCHS * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("_all", F.sum("source_size").over(everything) * (percent / 100))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(up), F.lit(0))) / F.sum("_w").over(down)
    per = per.withColumn("_level", level)
    # The level that holds is the first one that fills no further source.
    holds = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(holds["_level"] * F.col("_w"), F.col("_cap").cast("double")))
    return per.select(spread_key(F.col("source")).alias("_source"), "source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """`_slot, _source, _block`: which source every slot takes a block from, and its rank among that source's slots.

    The interval 0 to 1 is cut in proportion to the targets; slot i goes to the source whose part holds the i-th
    golden-ratio point, so that every stretch of slots is close to the weights.
    """
    spark = targets.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("target").over(Window.partitionBy())
    parts = targets.withColumn("_to", F.round(F.sum("target").over(order) / total * POINTS).cast("bigint"))
    parts = parts.withColumn("_from", F.coalesce(F.lag("_to").over(order), F.lit(0))).filter("_to > _from")
    n = targets.agg(F.ceil(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("bigint")).first()[0]
    numbers = spark.range(n).withColumnRenamed("id", "_slot")
    point = F.pmod(F.pmod("_slot", F.lit(POINTS)) * GOLDEN, F.lit(POINTS))
    width = POINTS // POINT_BUCKETS
    numbers = numbers.withColumn("_point", point).withColumn("_bucket", F.floor(F.col("_point") / width))
    parts = parts.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    inside = (F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))
    taken = numbers.join(parts, "_bucket").filter(inside).select("_source", F.expr("_slot div 65536").alias("_chunk"), "_slot")
    # Ranks in two steps, so that a source with most of the slots is not one task.
    chunks = taken.groupBy("_source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("_source", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_source", "_chunk").orderBy("_slot")) - 1
    return taken.withColumn("_rank", rank).join(chunks, ["_source", "_chunk"]).select("_slot", "_source", (F.col("_rank") + F.col("_before")).alias("_block"))


def _streams(docs: DataFrame) -> DataFrame:
    """`doc_id, source, _source, _size, _start, _doc`: the words of a source as one stream of shuffled documents.

    The order is that of a hash of doc_id; rows of one doc_id follow by size and hash of the text.
    """
    mixed = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        "doc_id", "source", spread_key(F.col("source")).alias("_source"), F.size(word_array(F.col("text"))).cast("bigint").alias("_size"),
        F.conv(F.substring(mixed, 1, 15), 16, 10).cast("bigint").alias("_at"), F.md5(F.coalesce("text", F.lit(""))).alias("_md5"),
        spread_key(*map(F.col, DOC_COLUMNS)).alias("_doc"),
    )
    rows = pin(rows.withColumn("_piece", F.expr(f"shiftright(_at, {60 - STREAM_BUCKETS.bit_length() + 1})")))
    pieces = rows.groupBy("_source", "_piece").agg(F.sum("_size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("_source", "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("_source", "_piece").orderBy("_at", "doc_id", "_size", "_md5", "_doc")
    inner = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    rows = rows.withColumn("_inner", inner).join(pieces, ["_source", "_piece"])
    return rows.select("doc_id", "source", "_source", "_size", (F.col("_inner") + F.col("_before")).alias("_start"), "_doc")


def mixture(docs: DataFrame, weights=WEIGHTS, percent: int = TOTAL_PERCENT, block: int = BLOCK_WORDS) -> DataFrame:
    """`doc_id, source, size, source_size, target, taken, copies, _doc` for every row of `docs`.

    Every source is a stream of its shuffled documents, cut into blocks of `block` words and run through at most
    MAX_EPOCHS times. A source's k-th slot of the schedule takes its k-th block. `taken` counts the words that blocks
    take of a document, repeats included; `copies` counts the passes in which a block takes its first word. A source's
    taken words miss its target by the few blocks by which the points miss the weights. Null texts have no words and
    nothing of them is taken; null sources are a source of their own; an empty table gives an empty result. Equal
    inputs give equal results, repeated rows are placed one after the other. Other columns are not looked at.
    """
    rows = pin(_streams(docs))
    targets = pin(source_targets(rows, weights, percent))
    rows = rows.join(targets.drop("source"), "_source")
    full = rows.filter("_size > 0")
    passes = full.select("_source", "_start", "_size", F.explode(F.expr(f"transform(sequence(0, {MAX_EPOCHS - 1}), e -> _start + e * source_size)")).alias("_from"))
    pieces = passes.select("_source", "_start", "_size", "_from", F.explode(F.expr(f"sequence(_from div {block}, (_from + _size - 1) div {block})")).alias("_block"))
    words = F.least(F.col("_from") + F.col("_size"), (F.col("_block") + 1) * block) - F.greatest("_from", F.col("_block") * block)
    first = (F.col("_from") >= F.col("_block") * block).cast("int")
    pieces = pieces.select("_source", "_start", "_block", words.alias("_words"), first.alias("_first"))
    met = pieces.join(schedule(targets, block), ["_source", "_block"])
    taken = met.groupBy("_source", "_start").agg(F.sum("_words").alias("_taken"), F.sum("_first").alias("_copies"))
    # Documents without words share their start with the next document, so they are kept out of the join.
    taken = taken.withColumn("_full", F.lit(True))
    rows = rows.withColumn("_full", F.col("_size") > 0).join(taken, ["_source", "_start", "_full"], "left")
    return rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"),
                       F.coalesce("_copies", F.lit(0)).cast("int").alias("copies"), "_doc")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix in the columns of `docs`: each whole document as often as the schedule takes its start.

    Null and empty texts have no words and are never taken. Rows that agree in id, source and text share their copies;
    an empty table gives an empty one.
    """
    copies = mixture(docs).filter("copies > 0").groupBy("_doc").agg(F.sum("copies").cast("int").alias("_copies"))
    rows, names = shielded(docs)
    rows = rows.withColumn("_doc", spread_key(*[F.col(names[c]) for c in DOC_COLUMNS]))
    # Repeated rows are alike, so one of them can stand for all their copies; rows that differ in other columns are not.
    same = rows.groupBy("_doc").agg(F.count(F.lit(1)).alias("_rows"))
    rows = rows.join(copies.join(same, "_doc"), "_doc")
    turn = F.row_number().over(Window.partitionBy("_doc").orderBy(*names.values()))
    once_each = rows.filter("_rows = 1").withColumn("_k", F.expr("_copies"))
    several = rows.filter("_rows > 1").withColumn("_k", F.expr("_copies div _rows").cast("int") + (turn <= F.expr("_copies % _rows")).cast("int"))
    rows = once_each.unionByName(several).filter("_k > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    return restored(rows, names)
