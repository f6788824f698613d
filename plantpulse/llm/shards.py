"""Shards of near-equal bytes: differencing over groups of equal texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.session import pin

ROW_OVERHEAD = 16
#: Units per shard: a group of at least a unit's bytes is placed by itself, smaller ones are first combined into units.
UNITS_PER_SHARD = 64
#: Groups of one bucket, and the number of buckets. What reaches the last step is at most
#: 2 * shards * UNITS_PER_SHARD + MAX_BUCKETS sizes, whatever the input.
BUCKET_GROUPS = 20_000
MAX_BUCKETS = 4096


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Part (0 to `ways` - 1) of every size, by differencing.

    Every size starts as a partial partition with one filled part. The two partial partitions with the largest spread
    are combined again and again, the largest part of one with the smallest part of the other, until one is left.
    """
    n = len(sizes)
    if n == 0 or ways == 1:
        return np.zeros(n, dtype=np.int32)
    live = {i: np.concatenate([[int(s)], np.zeros(ways - 1, dtype=np.int64)]).astype(np.int64) for i, s in enumerate(sizes)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = live.pop(a) + live.pop(b)[::-1]
        order = np.argsort(-sums, kind="stable").astype(np.int16)
        sums = sums[order]
        new = n + len(merges)
        merges.append((a, b, order))
        live[new] = sums
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), new))
    part = {n + len(merges) - 1: np.arange(ways, dtype=np.int32)}
    out = np.zeros(n, dtype=np.int32)
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        own, left, right = part.pop(node), np.empty(ways, dtype=np.int32), np.empty(ways, dtype=np.int32)
        left[order] = own
        right[ways - 1 - order] = own
        for child, labels in ((a, left), (b, right)):
            if child < n:
                out[child] = labels[0]
            else:
                part[child] = labels
    return out


def _bucket_units(unit: int):
    def units(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_bytes", "_h", "_crc"], ascending=[False, True, True], kind="stable")
        ways = max(1, round(int(rows["_bytes"].sum()) / unit))
        rows["_part"] = difference(rows["_bytes"].to_numpy(), ways)
        return rows[["_h", "_crc", "size", "_bytes", "_bucket", "_part"]]

    return units


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`slot`: place of each row in its group, from 0, by `order`, without gaps.

    Rows are range-partitioned by group and order, so a group may span many tasks; each piece then starts at the number
    of rows of the group in earlier pieces. The table of pieces has a row per task and group boundary.
    """
    placed = pin(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy("_piece", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(pieces, ["_piece", group]).withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_piece", "_first", "_before")


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` for every row of `docs`; law `bytes`.

    Size is the UTF-8 bytes of the text and 16; a null text has no bytes and is grouped with the empty text. Rows of
    equal text form one group and are never parted, so a group larger than a shard's share fills a shard alone. Small
    groups are spread over buckets by hash and combined there into units, at most about shards * UNITS_PER_SHARD in all;
    the units and the large groups are then differenced together. Equal inputs give equal shards. Slots run in order of
    doc_id, nulls first; repeated doc_ids are told apart by size and checksum, and full repeats are alike. An empty table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    light = pin(docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
                            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h")))
    groups = pin(light.groupBy("_h", F.col("text_crc32").alias("_crc"), "size").agg((F.count(F.lit(1)) * F.col("size")).alias("_bytes")))
    total, n = groups.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    unit = max(1, total // (shards * UNITS_PER_SHARD))
    buckets = min(MAX_BUCKETS, max(1, -(-n // BUCKET_GROUPS)))
    bucket = F.pmod(F.hash("_h", "size"), F.lit(buckets)).cast("bigint")
    small = groups.filter(F.col("_bytes") < unit).withColumn("_bucket", bucket)
    small = small.groupBy("_bucket").applyInPandas(_bucket_units(unit), "_h long, _crc long, size long, _bytes long, _bucket long, _part int")
    # A large group is a unit by itself: its bucket is negative and its part is its number.
    large = groups.filter(F.col("_bytes") >= unit).select("_h", "_crc", "size", "_bytes", F.lit(-1).cast("bigint").alias("_bucket"),
                                                          (F.row_number().over(Window.orderBy("_h", "_crc", "size")) - 1).alias("_part"))
    placed = pin(small.unionByName(large))
    units = placed.groupBy("_bucket", "_part").agg(F.sum("_bytes").alias("_bytes")).toPandas()
    units = units.sort_values(["_bytes", "_bucket", "_part"], ascending=[False, True, True], kind="stable")
    units["shard"] = difference(units["_bytes"].to_numpy(), shards)
    schema = "_bucket long, _part int, shard int"
    table = docs.sparkSession.createDataFrame([tuple(map(int, x)) for x in units[["_bucket", "_part", "shard"]].itertuples(index=False)], schema)
    where = placed.join(table, ["_bucket", "_part"]).select("_h", F.col("_crc").alias("text_crc32"), "size", "shard")
    rows = light.join(where, ["_h", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "shard")
    return numbered(rows, "shard", "doc_id", "size", "text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
