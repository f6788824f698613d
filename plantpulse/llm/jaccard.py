"""Jaccard join of documents on word shingles, by prefixes that are lengthened where a match is cheap to come by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.common import restored, shielded, spread_key
from plantpulse.llm.tokens import Words, groups, mix, words
from plantpulse.operators.components import components
from plantpulse.session import pin, scratch

SHINGLE_WORDS = 5
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle in the prefixes of more documents than this is common: it counts as a match but leads to no candidates.
COMMON = 16
#: Cost of the check of one candidate, in list entries read.
CHECK_COST = 8
#: Shingles of one bucket of lists, about; a bucket is worked on by one task at a time.
BUCKET_SHINGLES = 1_000_000
#: Shingles of prefixes that a task packs together.
PACK_SHINGLES = 1_000_000
#: Sets of one block in the comparison of sets that meet in lists of common shingles, and shingles of one matrix product.
BLOCK = 256
STRETCH = 16_384
#: A second choice of prefix, for documents that mostly hold common shingles, is longer than any first choice.
LONG = 1 << 30


def shingle_sets(text: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin."""
    counts = np.diff(text.first)
    h = text.hashes
    n = max(0, len(h) - SHINGLE_WORDS + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE_WORDS):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += h[j : j + n]
    size = np.where(counts < SHINGLE_WORDS, counts > 0, counts - SHINGLE_WORDS + 1)
    first = np.append(0, np.cumsum(size))
    long = np.repeat(counts >= SHINGLE_WORDS, size)
    keys = np.empty(first[-1], dtype=np.uint64)
    keys[long] = mix(rolled[(np.repeat(text.first[:-1] - first[:-1], size) + np.arange(first[-1]))[long]])
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        k = np.full(1, int(counts[i]), dtype=np.uint64)
        for w in h[text.first[i] : text.first[i + 1]]:
            k = k * np.uint64(0x9E3779B97F4A7C15) + w
        keys[first[i]] = mix(k ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0]
    # Plain sorts of the texts' own stretches take a fraction of the time of one order by text and key.
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        keys[begin:end].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[first[:-1][size > 0]] = True
    return keys[new], np.append(0, np.cumsum(new))[first]


def _class(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number per set; equal sets have equal numbers. The empty set is 0."""
    total = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(first)
    return np.where(n == 0, np.uint64(0), mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))).view(np.int64)


def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, keys, first key of each row, class of each row) for groups of rows."""
    for begin, end in groups(column):
        keys, first = shingle_sets(words(column.slice(begin, end - begin)))
        yield begin, end, keys, first, _class(keys, first)


def least_overlap(n):
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-n * PERCENT // 100)


def first_prefix(n):
    return n - least_overlap(n) + 1


def stored(n):
    """Length of the prefix that is looked at first. It holds the first choice of every possible partner: sets that link
    differ in size by a third at most."""
    return np.minimum(n, first_prefix(n) + n // 12 + 3)


def _ids(docs: DataFrame, more: str = "") -> DataFrame:
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, first, own in sets(batch.column("text")):
                held = [batch.column(c).slice(begin, end - begin) for c in names]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(first), pa.int64()), pa.array(own, pa.int64())], names=[*names, "n", "cid"])

    return docs.mapInArrow(run, ", ".join(filter(None, (f"doc_id {dict(docs.dtypes)['doc_id']}", more, "n long, cid long"))))


def _postings(docs: DataFrame, buckets: int, limit: int) -> DataFrame:
    """Prefix shingles in packed lists: `bucket, kind, keys, at, cids`. A shingle that more than `limit` different sets
    of one pack hold is common for certain; its documents are told so in rows of kind 1, which go to any bucket, and its
    own bucket only learns its name (kind 2). So no list of a common shingle travels to one task."""

    def pack(k: np.ndarray, at: np.ndarray, cids: np.ndarray, turn: int) -> pa.RecordBatch:
        order = np.lexsort((cids[at], k))
        k, at = k[order], at[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (cids[at[1:]] != cids[at[:-1]])
        k, at = k[new], at[new].astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(begin, len(k)))
        common = np.repeat(count > limit, count)
        out = []
        names = k[begin[count > limit]]
        if len(names):
            out.append(((int(cids[0]) + turn) % buckets, 1, k[common], at[common]))
            nb = (mix(names) % np.uint64(buckets)).astype(np.int32)
            out += [(int(b), 2, names[nb == b], None) for b in np.unique(nb)]
        k, at = k[~common], at[~common]
        # Prefixes hold small numbers, so a bucket is told by the mixed bits.
        bucket = (mix(k) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        k, at, bucket = k[order], at[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        out += [(b, 0, k[edges[b] : edges[b + 1]], at[edges[b] : edges[b + 1]]) for b in np.unique(bucket).tolist()]
        rows = {"bucket": [], "kind": [], "keys": [], "at": [], "cids": []}
        for b, kind, ks, a in out:
            used, place = np.unique(a, return_inverse=True) if a is not None else (np.zeros(0, dtype=np.int64), np.zeros(0))
            for name, value in zip(rows, (b, kind, ks.tobytes(), place.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), cids[used].tobytes()), strict=True):
                rows[name].append(value)
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("cids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_keys, n_sets, turn = [], 0, 0, 0
        for batch in batches:
            for _, _, keys, first, own in sets(batch.column("text")):
                n = np.diff(first)
                _, chosen = np.unique(own, return_index=True)
                chosen = chosen[n[chosen] > 0]
                length = stored(n[chosen])
                at = np.repeat(np.arange(len(chosen)), length)
                within = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
                held.append((keys[first[chosen][at] + within], at + n_sets, own[chosen].astype(np.int64)))
                n_keys, n_sets = n_keys + len(at), n_sets + len(chosen)
                if n_keys >= PACK_SHINGLES:
                    yield pack(*map(np.concatenate, zip(*held, strict=True)), turn)
                    held, n_keys, n_sets, turn = [], 0, 0, turn + 1
        if n_keys:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), turn)

    return docs.select("text").mapInArrow(run, "bucket int, kind int, keys binary, at binary, cids binary")


def _shared(table: pa.Table, limit: int) -> pa.Table:
    """`cid, key, df` of a bucket: shingles in at least two sets' prefixes; df is `limit` + 1 for common ones."""
    names, own, own_cids, told, told_cids = [], [], [], [], []
    for kind, keys, at, cids in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "at", "cids")), strict=True):
        k, c = np.frombuffer(keys, dtype=np.uint64), np.frombuffer(cids, dtype=np.int64)
        if kind == 2:
            names.append(k)
            continue
        place = np.frombuffer(at, dtype=np.uint16 if len(c) < 65536 else np.uint32)
        (own if kind == 0 else told).append(k)
        (own_cids if kind == 0 else told_cids).append(c[place])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    k, c, known = join(own, np.uint64), join(own_cids, np.int64), np.unique(join(names, np.uint64))
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    if len(k):
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        k, c = k[new], c[new]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(begin, len(k)))
    df = np.minimum(count, limit + 1)
    df[np.isin(k[begin], known)] = limit + 1
    df = np.repeat(df, count)
    keep = df > 1
    k, c, df = np.concatenate([k[keep], join(told, np.uint64)]), np.concatenate([c[keep], join(told_cids, np.int64)]), np.concatenate([df[keep], np.full(sum(map(len, told)), limit + 1)])
    return pa.table({"cid": pa.array(c, pa.int64()), "key": pa.array(k.view(np.int64), pa.int64()), "df": pa.array(df, pa.int32())})


def choose(df: np.ndarray, n: int, lengths: range, limit: int = COMMON) -> tuple[int, int] | None:
    """(matches asked for, matches among uncommon shingles asked for) of the cheapest prefix, or None.

    `df[i]` is how many sets hold shingle i in their prefixes. With `l` shared shingles asked for, the prefix is the
    first `first_prefix(n) + l - 1` shingles; any linked set of no smaller `l` shares l of them. Common ones may be among
    these, so l less their number is what the uncommon ones must reach. A longer prefix reads more lists but asks for more
    matches, and no more than (entries read) / (matches asked for) sets can have these.
    """
    p = first_prefix(n)
    common = np.concatenate([[0], np.cumsum(df > limit)])
    reads = np.concatenate([[0], np.cumsum(np.where(df > limit, 0, df - 1))])
    l = np.arange(lengths.start, min(lengths.stop, len(df) - p + 2))
    left = l - common[p + l - 1]
    l, left = l[left >= 1], left[left >= 1]
    if not len(l):
        return None
    best = int(np.argmin(reads[p + l - 1] * (1 + CHECK_COST / left)))
    return int(l[best]), int(left[best])


def _own_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, in order."""
    for _, _, keys, first, _ in sets(column):
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield keys[begin:end]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each list, in order."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        yield values[begin:end]


INDEX = "key long, cid long, n int, asked int, needed int"


def _first_choice(rows: DataFrame, limit: int) -> DataFrame:
    """Index entries of every set (`cid, text, keys, dfs`); sets without a choice give one entry with `asked` 0 each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for cid, own, ks, dfs in zip(batch.column("cid").to_pylist(), _own_sets(batch.column("text")), *map(_lists, (batch.column("keys"), batch.column("dfs"))), strict=True):
                n = len(own)
                df = np.ones(int(stored(n)), dtype=np.int64)
                df[np.searchsorted(own, ks.view(np.uint64))] = dfs
                got = choose(df, n, range(1, n // 16 + 2), limit)
                asked, needed = got or (0, 0)
                length = first_prefix(n) + asked - 1 if got else len(df)
                at = np.flatnonzero((df[:length] > 1) & ((df[:length] <= limit) | (asked == 0)))
                for values, value in zip(out, (own[at].view(np.int64), np.full(len(at), cid), np.full(len(at), n), np.full(len(at), asked), np.full(len(at), needed)), strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "cid", "n", "asked", "needed"])

    return rows.mapInArrow(run, INDEX)


def _second_choice(rows: DataFrame, limit: int) -> DataFrame:
    """Index entries of sets that mostly hold common shingles: `cid, text, keys, dfs` with the counts among such sets,
    and `keys1, dfs1` with the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            lists = [_lists(batch.column(c)) for c in ("keys", "dfs", "keys1", "dfs1")]
            for cid, own, ks, dfs, ks1, dfs1 in zip(batch.column("cid").to_pylist(), _own_sets(batch.column("text")), *lists, strict=True):
                n = len(own)
                df, df1 = np.ones(n, dtype=np.int64), np.ones(n, dtype=np.int64)
                df[np.searchsorted(own, ks.view(np.uint64))] = dfs
                df1[np.searchsorted(own, ks1.view(np.uint64))] = dfs1
                got = choose(df, n, range(n // 12 + 3, least_overlap(n) + 1), limit)
                place = np.arange(n)
                uncommon = ((df1 > 1) & (df1 <= limit)) | ((df > 1) & (df <= limit) & (place < (first_prefix(n) + got[0] - 1 if got else n)))
                at = np.flatnonzero(uncommon if got else uncommon | ((place < first_prefix(n)) & ((df > 1) | (df1 > 1))))
                asked, needed = got or (LONG, 1)
                for values, value in zip(out, (own[at].view(np.int64), np.full(len(at), cid), np.full(len(at), n), np.full(len(at), asked), np.full(len(at), needed)), strict=True):
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["key", "cid", "n", "asked", "needed"])

    return rows.mapInArrow(run, INDEX)


def _explode_sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, keys, first, _ in sets(batch.column("text")):
                cids = np.repeat(batch.column("cid").slice(begin, end - begin).to_numpy(), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(keys.view(np.int64), pa.int64())], names=["cid", "key"])

    return rows.select("cid", "text").mapInArrow(run, "cid long, key long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs `a, b` whose sets link, by the sets of their texts."""
    rows = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # Rows come in order of a, so the set of one is made once.
            a = batch.column("a").to_numpy()
            turn = np.append(True, a[1:] != a[:-1])
            heads, keep, own = _own_sets(batch.column("text_a").filter(pa.array(turn))), [], None
            for i, (new, other) in enumerate(zip(turn.tolist(), _own_sets(batch.column("text_b")), strict=True)):
                if new:
                    own = next(heads)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in keep], pa.int64()), pa.array([right[i] for i in keep], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _near(a: str, b: str):
    """Sets of these sizes can link."""
    return F.col(a) * 100 >= F.col(b) * PERCENT, F.col(b) * 100 >= F.col(a) * PERCENT


def _best_heads(index: DataFrame, head) -> DataFrame:
    """`a, b`: for every set the head it shares most lists with; a list's head is its smallest or largest set."""
    heads = index.groupBy("key").agg(head("cid").alias("a"), head(F.struct("cid", "n")).getField("n").alias("n_a"))
    small, large = _near("n", "n_a")
    met = index.join(heads, "key").filter((F.col("cid") != F.col("a")) & small & large)
    counts = met.groupBy(F.col("cid").alias("b"), "a").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def _cross(index: DataFrame, member: DataFrame) -> DataFrame:
    """`a, b`: sets of different components that share as many lists as the one with the shorter prefix asks for."""
    rows = index.join(member, index["cid"] == member["node"], "left").drop("node").withColumn("component", F.coalesce("component", "cid"))
    mixed_lists = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rows = pin(rows.join(mixed_lists, "key"))
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "asked", "needed", "component")])
    small, large = _near("n", "n_b")
    met = rows.join(other, "key").filter((F.col("component") < F.col("component_b")) & small & large)
    need = (F.when(F.col("asked") < F.col("asked_b"), F.col("needed")).when(F.col("asked") > F.col("asked_b"), F.col("needed_b"))
            .otherwise(F.greatest("needed", "needed_b")))
    counts = met.groupBy(F.col("cid").alias("a"), F.col("cid_b").alias("b"), need.alias("need")).agg(F.count(F.lit(1)).alias("c"))
    return counts.filter("c >= need").select("a", "b")


def _compare_blocks(table: pa.Table) -> pa.Table:
    """`a, b`: enough links between the rows of side 0 and those of side 1 to connect what they connect.

    Intersections of all sets of two blocks are one product of matrices, in stretches of shingles. Rows of side 2 are on both sides.
    """
    cid, component, side = (table.column(c).to_numpy() for c in ("cid", "component", "side"))
    if component.min() == component.max():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    column = table.column("text").combine_chunks()
    keys, first = shingle_sets(words(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column))
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    names, place = np.unique(keys, return_inverse=True)
    often = np.bincount(place, minlength=len(names)) > 1
    number = np.cumsum(often) - 1
    row, place = row[often[place]], number[place[often[place]]]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, int(often.sum()), STRETCH):
        own = (place >= begin) & (place < begin + STRETCH)
        held = np.zeros((len(n), min(STRETCH, int(often.sum()) - begin)), dtype=np.float32)
        held[row[own], place[own] - begin] = 1
        both += held[left] @ held[right].T
    both = np.rint(both).astype(np.int64)
    linked = (100 * both >= PERCENT * (n[left][:, None] + n[right][None, :] - both)) & (component[left][:, None] != component[right][None, :])
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        x, y = root(int(component[left[i]])), root(int(component[right[j]]))
        if x != y:
            parent[x] = y
            out.append((int(cid[left[i]]), int(cid[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _dense_links(index: DataFrame, long_lists: DataFrame, member: DataFrame, texts: DataFrame) -> DataFrame:
    """`a, b`: links of sets that meet in lists of common shingles, where no prefix tells them apart.

    Sets that are connected by such lists are a group. A group is cut into blocks of BLOCK sets of similar size, and every
    two blocks whose sizes can link are compared in a task of their own: a group of any size is many bounded tasks, and no
    row is made for a pair. Blocks that are in one component already are not looked at.
    """
    rows = index.join(long_lists, "key", "left_semi").select("key", "cid", "n")
    heads = rows.groupBy("key").agg(F.min("cid").alias("a"))
    groups_of = components(rows.join(heads, "key").select("a", F.col("cid").alias("b")).distinct())
    sets_of = rows.select("cid", "n").distinct().join(groups_of, F.col("cid") == F.col("node"))
    sets_of = sets_of.select("cid", F.col("component").alias("g"), F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int").alias("s"))
    sets_of = sets_of.join(member, sets_of["cid"] == member["node"], "left").withColumn("component", F.coalesce("component", "cid")).drop("node")
    mixed_groups = sets_of.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("g")
    sets_of = sets_of.join(mixed_groups, "g")
    sizes = pin(sets_of.groupBy("g", "s").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    placed = sets_of.join(sizes, ["g", "s"]).withColumn("h", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    above = sizes.select("g", (F.col("s") - 1).alias("s"), F.col("blocks").alias("above"))
    below = sizes.select("g", (F.col("s") + 1).alias("s"), F.col("blocks").alias("below"))
    placed = placed.join(above, ["g", "s"], "left").join(below, ["g", "s"], "left")
    tasks = F.expr("""concat(
        transform(sequence(0, blocks - 1), k -> named_struct('s1', s, 'h1', least(h, k), 's2', s, 'h2', greatest(h, k), 'side', if(k = h, 2, if(h < k, 0, 1)))),
        if(above is null, array(), transform(sequence(0, coalesce(above, 1) - 1), k -> named_struct('s1', s, 'h1', h, 's2', s + 1, 'h2', k, 'side', 0))),
        if(below is null, array(), transform(sequence(0, coalesce(below, 1) - 1), k -> named_struct('s1', s - 1, 'h1', k, 's2', s, 'h2', h, 'side', 1))))""")
    dealt = placed.select("g", "cid", "component", F.inline(tasks)).join(texts, "cid")
    return dealt.groupBy("g", "s1", "h1", "s2", "h2").applyInArrow(_compare_blocks, "a long, b long")


def near_duplicates(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row of `docs`.

    Sets of shingles are compared through 64-bit hashes; rows with equal sets are one class and linked. Between classes, every
    link is looked for except where both are in one component already, so components are exact while large groups of
    near copies need no pair of every two. Empty and null texts are linked with nothing; of rows without a doc_id the
    smallest doc_id of their component is given, null if it has none; an empty table gives an empty result; other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    ids = pin(_ids(docs))
    member = class_components(docs, ids, common)
    rows = ids.join(member, ids["cid"] == member["node"], "left").withColumn("_c", F.coalesce("component", "cid"))
    full = rows.filter("n > 0")
    names = full.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(names, "_c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def class_components(docs: DataFrame, ids: DataFrame, limit: int = COMMON) -> DataFrame:
    """`node, component` of the classes that link with another class; what is written on the way is removed."""
    with scratch(docs.sparkSession) as keep:
        return keep(_class_components(docs, ids, limit))


def _class_components(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (2 * BUCKET_SHINGLES)))
    shared = pin(_postings(docs, buckets, limit).groupBy("bucket").applyInArrow(lambda t: _shared(t, limit), "cid long, key long, df int"))
    lists = shared.groupBy("cid").agg(F.collect_list(F.struct("key", "df")).alias("l")).select("cid", F.col("l.key").alias("keys"), F.col("l.df").alias("dfs"))
    texts = pin(_class_texts(docs).join(shared.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.first("text").alias("text")))
    first = pin(_first_choice(texts.join(lists, "cid"), limit))
    late = pin(first.filter("asked = 0").groupBy("cid").agg(F.lit(1).alias("_one")).select("cid"))
    late_texts = texts.join(late, "cid", "left_semi")
    entries = pin(_explode_sets(late_texts))
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counts = entries.join(counts.withColumn("df", F.least("df", F.lit(limit + 1))), "key").groupBy("cid").agg(F.collect_list(F.struct("key", F.col("df").cast("int").alias("df"))).alias("l"))
    second = late_texts.join(counts, "cid", "left").join(lists.select("cid", F.col("keys").alias("keys1"), F.col("dfs").alias("dfs1")), "cid")
    none = F.array()
    second = second.select("cid", "text", F.coalesce("l.key", none.cast("array<bigint>")).alias("keys"), F.coalesce("l.df", none.cast("array<int>")).alias("dfs"), "keys1", "dfs1")
    index = pin(first.filter("asked > 0").unionByName(_second_choice(second, limit)))
    links = pin(_linked(_best_heads(index, F.min), texts))
    member = components(links)
    open_lists = index.join(member, index["cid"] == member["node"], "left").withColumn("_c", F.coalesce("component", "cid"))
    mixed_lists = open_lists.groupBy("key").agg(F.min("_c").alias("low"), F.max("_c").alias("high")).filter("low < high").select("key")
    again = _best_heads(index.join(mixed_lists, "key", "left_semi"), F.max)
    links = pin(links.unionByName(_linked(again, texts)))
    member = components(links)
    # Lists longer than this hold only sets of the second choice that are full of common shingles.
    long_lists = pin(index.groupBy("key").count().filter(F.col("count") > 2 * limit).select("key"))
    dense = pin(_dense_links(index, long_lists, member, texts))
    links = pin(links.unionByName(dense))
    member = components(links)
    links = links.unionByName(pin(_linked(_cross(index.join(long_lists, "key", "left_anti"), member), texts)))
    return components(links)


def _class_texts(docs: DataFrame) -> DataFrame:
    """`cid, text`: of each group of rows one text per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for begin, end, _, first, own in sets(column):
                _, chosen = np.unique(own, return_index=True)
                chosen = chosen[np.diff(first)[chosen] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(own[chosen], pa.int64()), column.slice(begin, end - begin).take(pa.array(chosen)).cast(pa.string())], names=["cid", "text"])

    return docs.select("text").mapInArrow(run, "cid long, text string")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that have a smaller document in their component.

    A component's smallest doc_id stays, null only where it has no other; of several rows with it the one with the
    smallest hash of the text, and of full repeats one. Rows without words are linked with nothing and all stay.
    """
    rows, names = shielded(docs)
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    rows = rows.withColumn("_key", spread_key(doc_id, text)).withColumn("_empty", ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    plain = docs.select("doc_id", "text")
    ids = pin(_ids(plain.withColumn("_key", spread_key(F.col("doc_id"), F.col("text"))), "_key long"))
    member = class_components(plain, ids)
    full = ids.filter("n > 0").join(member, ids["cid"] == member["node"], "left").withColumn("_c", F.coalesce("component", "cid"))
    keep = full.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).getField("_key").alias("_key")).select("_key")
    kept = rows.filter("not _empty").join(keep, "_key", "left_semi")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy(*names.values()))
    return restored(kept.withColumn("_turn", turn).filter("_turn = 1").drop("_turn").unionByName(rows.filter("_empty")), names)
