"""The prefix trie of rebuilt conversations: ROLLUP over positional turn-id columns, in blocks of turns.

A conversation becomes one row per block of `WIDTH` turns with a turn id in each positional column, keyed by the trie
node at which the block before ends. One ROLLUP over the columns then aggregates all prefixes of all blocks together, and
`grouping_id` tells how deep a group lies in its block. A node is named by the 128-bit combination of its (position, turn)
hashes, so that blocks need not be handled one after the other.

Sums over subtrees come from sums over members. Of the nodes on its path a conversation owns those it is the smallest
member of; these are the last ones of the path. What a conversation owns belongs to the subtree of each node it is a
member of, save that of the nodes above the first owned one only the smallest member has nodes in common with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.common import word_array
from plantpulse.operators.ordered import InOrder
from plantpulse.session import pin

#: Turns in a block: a row becomes `WIDTH + 1` rows inside ROLLUP, which combine before the shuffle.
WIDTH = 8
#: Conversations take their first turns from the one at the begin of their group of so many ids, and up to `SHARED - 1` turns.
FAMILY, SHARED = 20, 4

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _before(edge: Column, aggregate, order) -> Column:
    return F.coalesce(aggregate(edge).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, pos, role_text (a, b), words`: turns with their position from 1 and 128 bits that stand for (role, text).

    The order is by turn, null first; turns of one number are ordered by role and text. Rows without a conv_id belong
    to no conversation and are left out.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "role", "text", "row"]
    cut = rows.repartitionByRange("conv_id", *order).withColumn("piece", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "piece").orderBy(*order)
    local = cut.select(
        "conv_id", "piece", F.row_number().over(inside).cast("bigint").alias("pos"),
        F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.length("text"), "role").alias("b"),
        F.size(word_array(F.col("text"))).cast("bigint").alias("words"),
    )
    local = pin(local)
    pieces = local.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = pieces.select("conv_id", "piece", _before(F.col("n"), F.sum, Window.partitionBy("conv_id").orderBy("piece")).alias("before"))
    joined = local.join(earlier, ["conv_id", "piece"])
    return joined.select("conv_id", (F.col("pos") + F.col("before")).alias("pos"), "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of the rebuilt conversations at their new positions, hashed with these."""
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = [F.max(F.when(F.col("pos") == i, F.struct("a", "b", "words"))).alias(f"s{i}") for i in range(1, SHARED)]
    bases = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(*firsts)
    plans = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    lead = F.filter(F.slice(F.array(*[f"s{i}" for i in range(1, SHARED)]), F.lit(1), F.col("h").cast("int")), lambda x: x.isNotNull())
    plans = plans.join(bases, "base", "left").select("conv_id", "h", lead.alias("lead"))
    taken = plans.select("conv_id", F.posexplode("lead").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("bigint").alias("pos"), "t.*")
    own = turns.join(plans.select("conv_id", "h", F.size("lead").alias("k")), "conv_id").filter("pos > h")
    both = taken.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "words"))
    hashed = both.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("a"), F.xxhash64("b", "pos", "a").alias("b"), "words")
    return ids.select("conv_id"), hashed


def blocks(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """`conv_id, block, ka, kb, pw, t1..t8`: the key of the node before the block, the words up to there, and the turns.

    A conversation without turns has a block without turns.
    """
    place = (F.col("pos") - 1) % WIDTH
    columns = [F.max(F.when(place == i, F.struct("a", "b", "words"))).alias(f"t{i + 1}") for i in range(WIDTH)]
    sums = [F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("words").alias("w")]
    cut = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(*columns, *sums)
    turnless = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("block", F.lit(0).cast("bigint"))
    ordered = InOrder(cut.unionByName(turnless, allowMissingColumns=True), ["conv_id"], ["block"])
    parts = {"ka": (F.bit_xor, "xa"), "kb": (F.bit_xor, "xb"), "pw": (F.sum, "w")}
    edges = ordered.df.groupBy(*ordered.keys).agg(*[f(c).alias(name) for name, (f, c) in parts.items()])
    across = Window.partitionBy("conv_id").orderBy(ordered.keys[-1])
    edges = edges.select(*ordered.keys, *[_before(F.col(name), f, across).alias(f"_{name}") for name, (f, _) in parts.items()])
    rows = ordered.df.select("*", *[_before(F.col(c), f, ordered.window()).alias(name) for name, (f, c) in parts.items()]).join(edges, ordered.keys)
    keys = [F.col("ka").bitwiseXOR(F.col("_ka")).alias("ka"), F.col("kb").bitwiseXOR(F.col("_kb")).alias("kb"), (F.col("pw") + F.col("_pw")).alias("pw")]
    return rows.select("conv_id", "block", *keys, *[f"t{i + 1}" for i in range(WIDTH)])


def _rolled(rows: DataFrame, **aggregates: str) -> DataFrame:
    """All prefixes: `depth, na, nb` name the node, `ua, ub` its parent, `pw` has the words before its last turn, `w` its own."""
    turns = [f"t{i + 1}" for i in range(WIDTH)]
    made = ", ".join(f"{sql} AS {name}" for name, sql in aggregates.items())
    grouped = rows.sparkSession.sql(
        f"""SELECT block, ka, kb, pw, {', '.join(turns)}, grouping_id() AS gid, {made} FROM {{rows}}
            GROUP BY block, ka, kb, pw, ROLLUP({', '.join(turns)})""", rows=rows)
    # The rolled-up columns are the lowest bits of grouping_id.
    inside = WIDTH - F.bit_count("gid").cast("int")
    grouped = grouped.withColumn("d", inside).withColumn("last", F.expr(f"get(array({', '.join(turns)}), d - 1)"))
    grouped = grouped.filter("last IS NOT NULL OR (d = 0 AND block = 0)")
    key = {}
    for k, part in (("na", "a"), ("nb", "b")):
        key[k] = F.col(f"k{part}")
        for t in turns:
            key[k] = key[k].bitwiseXOR(F.coalesce(F.col(f"{t}.{part}"), F.lit(0).cast("bigint")))
    words = sum((F.coalesce(F.col(f"{t}.words"), F.lit(0).cast("bigint")) for t in turns), F.col("pw"))
    own = F.coalesce(F.col("last.words"), F.lit(0).cast("bigint"))
    up = [F.when(F.col("last").isNotNull(), key[n].bitwiseXOR(F.col(f"last.{p}"))).alias(u) for n, p, u in (("na", "a", "ua"), ("nb", "b", "ub"))]
    depth = (F.col("block") * WIDTH + F.col("d")).cast("bigint")
    return grouped.select(depth.alias("depth"), *[c.alias(n) for n, c in key.items()], *up, (words - own).alias("pw"), own.alias("w"), *aggregates)


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined `conv_id`s, ascending, of each `depth, na, nb`.

    A hash takes its bytes in order, so the ids of one node end in one task; but they come to it as long pieces of text,
    made where the ids lie in order, and run through the hash in a stream.
    """
    key = "depth bigint, na bigint, nb bigint"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch[i].to_numpy() for i in range(3)]
            change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
            begin = np.concatenate([[0], change])
            end = np.concatenate([change, [batch.num_rows]])
            ids = batch[3].to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[begin]) for x in names], batch[3].take(pa.array(begin)), pa.array(texts, pa.string())], ["depth", "na", "nb", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for depth, na, nb, ids in zip(*[batch[c].to_pylist() for c in ("depth", "na", "nb", "ids")], strict=True):
                if (depth, na, nb) == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = (depth, na, nb), hashlib.sha256()
                state.update(ids.encode())
            yield pack(done)
        if current is not None:
            yield pack([(*current, state.hexdigest())])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["depth", "na", "nb", "ends_sha256"])

    order = ["depth", "na", "nb", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{key}, first bigint, ids string")
    return pieces.repartition("depth", "na", "nb").sortWithinPartitions("depth", "na", "nb", "first").mapInArrow(hashed, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    Columns `conv_id, turn, role, text` are read, others are not. A null role or text is empty, a null turn comes first,
    turns of one number go by role and text, repeated rows are turns of their own, rows without a conv_id are left out.
    A conversation without turns after rebuilding is a member of the root alone. An empty table has no node.
    """
    ids, turns = rebuilt(numbered_turns(conversations))
    turns = pin(turns)
    rows = pin(blocks(ids, turns))
    totals = ids.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.sum("words").alias("w"), F.bit_xor("a").alias("ea"), F.bit_xor("b").alias("eb")), "conv_id", "left").na.fill(0)

    first = pin(_rolled(rows.join(totals.select("conv_id", "len"), "conv_id"), conv_id="min(conv_id)", longest="max(len)"))
    owners = first.groupBy("conv_id").agg(F.min(F.struct("depth", "ua", "ub", "pw")).alias("top"), F.max((F.col("longest") == F.col("depth")).cast("bigint")).alias("leaf"))
    owners = owners.select("conv_id", "leaf", F.col("top.depth").alias("top"), F.col("top.pw").alias("pw"), (F.col("top.depth") - 1).alias("depth"), F.col("top.ua").alias("na"), F.col("top.ub").alias("nb"))
    above = first.select("depth", "na", "nb", F.col("conv_id").alias("parent"))
    owners = owners.join(above, ["depth", "na", "nb"], "left").select("conv_id", "leaf", "top", "pw", "parent")
    convs = totals.join(owners, "conv_id", "left").select(
        "conv_id", "len", "w", "ea", "eb", "top", "parent", F.coalesce(F.col("w") - F.col("pw"), F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    convs = pin(convs)

    # Inside a subtree each conversation counts its words from the node on; the trie counts the owned ones once.
    second = _rolled(rows.join(convs.drop("ea", "eb"), "conv_id"), n_convs="count(*)", all_words="sum(w)", all_owned="sum(owned)", n_leaves="sum(leaf)",
                     least="min(struct(conv_id, len, w, owned, top, parent))")
    n, pw, m = F.col("n_convs"), F.col("pw"), F.col("least")
    nodes = second.select(
        "depth", "na", "nb", m["conv_id"].alias("conv_id"), F.when(m["top"] < F.col("depth"), m["conv_id"]).otherwise(m["parent"]).alias("parent_conv_id"),
        "n_convs", "n_leaves", (m["len"] > F.col("depth")).cast("bigint").alias("goes_on"),
        ((F.col("all_words") - n * pw) - (F.col("all_owned") - m["owned"] + m["w"] - pw)).alias("saved_tokens"),
    )
    branches = convs.filter("top > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("others"))
    ends = end_hashes(convs.select(F.col("len").alias("depth"), F.col("ea").alias("na"), F.col("eb").alias("nb"), "conv_id"))
    joined = nodes.join(branches, ["conv_id", "depth"], "left").join(ends, ["depth", "na", "nb"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("goes_on") + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
