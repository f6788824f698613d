"""Repeated passages: prefix-free parsing, and an order of the suffixes of its dictionary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.common import spread_key
from plantpulse.llm.tokens import GROUP_BYTES, groups, mix, powers, text_bytes
from plantpulse.session import pin

MATCH_BYTES = 50
TRIGGER_BYTES = 12
#: Trigger positions in a match.
PLACES = MATCH_BYTES - TRIGGER_BYTES + 1
#: A match reaches this far to the left or to the right of its trigger, or further.
SIDE = PLACES // 2
#: Phrases of one bucket, and dictionary suffixes of one bucket, about.
BUCKET_PHRASES = 1_000_000
BUCKET_RUNS = 1_000_000
#: Phrases, and dictionary suffixes, that a task packs together.
PACK_PHRASES = 1_000_000
PACK_RUNS = 1_000_000
#: No text of a row has 2**31 bytes.
_AT_BITS = 31
_BYTES, _OTHER_BYTES = (np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (50, 51))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


@dataclass
class Phrases:
    """The parse of a group of texts. A phrase is a trigger and all matches that it is the trigger of: matches begin at
    `low` to `high`, so its bytes are `low` to `high + MATCH_BYTES`. `row` is the text; `number` counts within it."""

    row: np.ndarray
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray
    key: np.ndarray
    content: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    span, have = 1, values
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def _side(hashes: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Name of a side in 16 bits: 1 to 65535, and 0 only where there is none."""
    return np.where(there, hashes % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def phrases(data: np.ndarray, offsets: np.ndarray) -> Phrases:
    """A rolling hash of TRIGGER_BYTES bytes picks the triggers: each run of MATCH_BYTES bytes has the smallest hash in
    it as its trigger, the leftmost of equal ones. So equal runs have the same trigger wherever they stand, and no phrase
    is longer than two matches."""
    n = len(data)
    none = Phrases(*[np.zeros(0, dtype=np.int64)] * 5, *[np.zeros(0, dtype=np.uint64)] * 2, *[np.zeros(0, dtype=np.uint16)] * 2)
    if n < MATCH_BYTES:
        return none
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(n, _BASE), out=total[1:])
    back = powers(n + 1, _INVERSE)

    def rolled(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))

    h = mix((total[TRIGGER_BYTES:] - total[:-TRIGGER_BYTES]) * back[: n - TRIGGER_BYTES + 1])
    at = np.uint64((1 << _AT_BITS) - 1)
    least = _least((h & ~at) | np.arange(len(h), dtype=np.uint64), PLACES)
    trigger = (least & at).astype(np.int64)
    begin = np.arange(len(trigger))
    valid = np.zeros(n + 1, dtype=np.int8)
    lengths = np.diff(offsets)
    long = lengths >= MATCH_BYTES
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - MATCH_BYTES + 1, -1)
    valid = np.cumsum(valid[: len(trigger)], dtype=np.int64) > 0
    new = np.ones(len(trigger), dtype=bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    # A text that follows at once begins a phrase of its own.
    new[offsets[:-1][long]] = True
    new &= valid
    low = begin[new]
    if not len(low):
        return none
    last = np.ones(len(trigger), dtype=bool)
    last[:-1] = new[1:] | ~valid[1:]
    high = begin[last & valid]
    p = trigger[low]
    row = np.searchsorted(offsets, low, side="right") - 1
    first = np.searchsorted(row, np.arange(len(lengths)))
    end = np.minimum(high + MATCH_BYTES, n)
    left, right = p - SIDE, p + TRIGGER_BYTES + SIDE
    has_left, has_right = left >= offsets[row], right <= offsets[row + 1]
    return Phrases(
        row, np.arange(len(low)) - first[row], low, high, p, h[p], rolled(low, end),
        _side(rolled(np.maximum(left, 0), p + TRIGGER_BYTES), has_left), _side(rolled(p, np.minimum(right, n)), has_right),
    )


def _planes(values: np.ndarray) -> bytes:
    """Byte planes, which compress where numbers are small."""
    if not len(values):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = zstandard.ZstdDecompressor().decompress(data) if data else b""
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).reshape(-1).view(kind) if planes else np.zeros(0, dtype=kind)


def _steps(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as what each adds to the one before, for numbers that mostly rise."""
    return _planes(np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint32), dtype=np.uint32)


PACK = "bucket int, kind int, keys binary, contents binary, sides binary, texts binary, numbers binary, docs binary, rows binary"
_FIELDS = [f.split()[0] for f in PACK.split(", ")]
_PACK_SCHEMA = pa.schema([(n, pa.int32() if n in ("bucket", "kind") else pa.binary()) for n in _FIELDS])


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """The phrases of the texts by bucket of their trigger, packed. Of the equal phrases of one group of texts only the smallest
    document's travels; those of later documents are repeats for certain (kind 1) and go to any bucket."""

    def pack(text, number, key, content, left, right, ids, names, turn: int) -> pa.RecordBatch:
        doc = ids[text]
        order = np.lexsort((number, doc, content, key))
        text, number, key, content, left, right, doc = (x[order] for x in (text, number, key, content, left, right, doc))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        later = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        sides = left.astype(np.uint32) << np.uint32(16) | right
        small = (mix(key ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)

        def row(bucket: int, kind: int, chosen: np.ndarray) -> tuple:
            chosen = chosen[np.argsort(small[chosen], kind="stable")]
            texts, place = np.unique(text[chosen], return_inverse=True)
            only = chosen if kind == 0 else chosen[:0]
            return (bucket, kind, _steps(small[only]), content[only].tobytes(), _planes(sides[only]),
                    _planes(place.astype(np.uint32)), _planes(number[chosen].astype(np.uint32)), ids[texts].tobytes(), names[texts].tobytes())

        out = [row((int(names[0]) + turn) % buckets, 1, np.flatnonzero(later))] if later.any() else []
        bucket = (mix(key) % np.uint64(buckets)).astype(np.int32)
        rest = np.flatnonzero(~later)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        there, at = np.unique(bucket[rest], return_index=True)
        out += [row(int(b), 0, chosen) for b, chosen in zip(there, np.split(rest, at[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _PACK_SCHEMA, strict=True)], schema=_PACK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, n_texts, turn = [], 0, 0, 0
        for batch in batches:
            ids, names = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("_row").to_numpy()
            for begin, end in groups(batch.column("text")):
                found = phrases(*text_bytes(batch.column("text").slice(begin, end - begin)))
                held.append((found.row + n_texts, found.number, found.key, found.content, found.left, found.right, ids[begin:end], names[begin:end]))
                n, n_texts = n + len(found.row), n_texts + end - begin
                if n >= PACK_PHRASES:
                    yield pack(*map(np.concatenate, zip(*held, strict=True)), turn)
                    held, n, n_texts, turn = [], 0, 0, turn + 1
        if n:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), turn)

    return docs.select("doc_id", "_row", "text").mapInArrow(run, PACK)


#: A phrase that a smaller document has as a whole, and the sides that it shares with another document.
WHOLE, LEFT, RIGHT = range(3)


def _marks(table: pa.Table) -> pa.Table:
    """`_row, number, mark` of a bucket: phrases that a smaller document has as a whole (WHOLE), and the first ones of their
    content that share a trigger and its LEFT or RIGHT side, or both (their sum), with a phrase of another document."""
    small, content, sides, doc, row, number, told = [], [], [], [], [], [], []
    for r in zip(*(table.column(c).to_pylist() for c in _FIELDS[1:]), strict=True):
        kind, keys, contents, side, texts, numbers, docs, rows = r
        place = _from_planes(texts, np.uint32)
        n = _from_planes(numbers, np.uint32)
        if kind == 1:
            told.append((np.frombuffer(rows, dtype=np.int64)[place], n))
            continue
        small.append(_from_steps(keys))
        content.append(np.frombuffer(contents, dtype=np.uint64))
        sides.append(_from_planes(side, np.uint32))
        doc.append(np.frombuffer(docs, dtype=np.int64)[place])
        row.append(np.frombuffer(rows, dtype=np.int64)[place])
        number.append(n)
    out_row, out_number, out_mark = [x for x, _ in told], [x for _, x in told], [np.full(len(x), WHOLE, dtype=np.int32) for x, _ in told]
    if small:
        small, content, sides, doc, row, number = map(np.concatenate, (small, content, sides, doc, row, number))
        order = np.lexsort((doc, content, small))
        small, content, sides, doc, row, number = (x[order] for x in (small, content, sides, doc, row, number))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (small[1:] != small[:-1]) | (content[1:] != content[:-1])
        smallest = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        whole = doc > smallest
        heads = np.flatnonzero(~whole)
        shared = np.zeros(len(order), dtype=np.int32)
        for mark, shift in ((LEFT, 16), (RIGHT, 0)):
            side = (sides[heads] >> np.uint32(shift)) & np.uint32(0xFFFF)
            name = (small[heads].astype(np.uint64) << np.uint64(16)) | side
            by = np.lexsort((doc[heads], name))
            name, d = name[by], doc[heads][by]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            stop = np.append(start[1:], len(name))
            several = np.repeat(d[start] < d[stop - 1], stop - start)
            shared[heads[by[several & (name & np.uint64(0xFFFF) != 0)]]] += mark
        for chosen in (whole, shared > 0):
            out_row.append(row[chosen])
            out_number.append(number[chosen])
            out_mark.append(np.where(whole, WHOLE, shared)[chosen].astype(np.int32))
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.table({"_row": join(out_row, pa.int64()), "number": join([x.astype(np.int64) for x in out_number], pa.int32()), "mark": join(out_mark, pa.int32())})


def _compressed(docs: DataFrame) -> DataFrame:
    """The texts as they are moved: compressed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["_row", "doc_id", "packed"])

    return docs.filter(F.octet_length("text") >= MATCH_BYTES).select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, packed binary")


def _opened(packed: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Texts in groups of about GROUP_BYTES bytes: which rows, their bytes, and where each text begins."""
    unpack = zstandard.ZstdDecompressor().decompress
    begin, size, texts = 0, 0, []
    for i in range(len(packed)):
        texts.append(unpack(packed[i].as_py()))
        size += len(texts[-1])
        if size >= GROUP_BYTES or i == len(packed) - 1:
            yield slice(begin, i + 1), np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
            begin, size, texts = i + 1, 0, []


def _places(found: Phrases, numbers: pa.Array) -> np.ndarray:
    """Places in `found` of the phrases whose numbers are listed per text."""
    first = np.searchsorted(found.row, np.arange(len(numbers)))
    lengths = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.unique(np.repeat(first, lengths) + numbers.flatten().to_numpy(zero_copy_only=False))


def _stretches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each `low` to its `high`."""
    lengths = np.maximum(high - low + 1, 0)
    return np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _named(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit names of the runs of MATCH_BYTES bytes that begin at `at`."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers(len(data), _BASE), out=total[1:])
    return mix((total[at + MATCH_BYTES] - total[at]) * powers(len(data) + 1, _INVERSE)[at])


def _later(doc: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same name. All are brought into one order, in which equal names stand side by side."""
    order = np.lexsort((doc, *names))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for name in names:
        new[1:] |= name[order][1:] != name[order][:-1]
    d = doc[order]
    later = np.zeros(len(order), dtype=bool)
    later[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
    return later


RUNS = "pack long, bucket int, kind int, names binary, docs binary, members binary, texts binary, begins binary, rows binary"
_RUN_FIELDS = [f.split()[0] for f in RUNS.split(", ")]
_RUN_SCHEMA = pa.schema([(n, {"pack": pa.int64(), "bucket": pa.int32(), "kind": pa.int32()}.get(n, pa.binary())) for n in _RUN_FIELDS])


def _runs(held: DataFrame, buckets: int) -> DataFrame:
    """The suffixes of the edges by bucket, packed: the dictionary entries that have to be compared.

    Only the first MATCH_BYTES bytes of a suffix count. On a LEFT edge these are the suffixes that hold the left side of
    the trigger, on a RIGHT edge those that hold the right one. Of equal ones of a pack only the smallest document's
    travel, so what is frequent travels once a pack; those of later documents are repeats for certain (kind 1). The row
    of kind 1 also tells the pack's rows."""

    def pack(serial: int, text, begin, bucket, name, ids, rows) -> pa.RecordBatch:
        later = _later(ids[text], name, bucket)
        out = [(serial, serial % buckets, 1, b"", b"", b"", _steps(text[later]), _steps(begin[later]), rows.tobytes())]
        rest = np.flatnonzero(~later)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        there, at = np.unique(bucket[rest], return_index=True)
        for b, chosen in zip(there, np.split(rest, at[1:]), strict=True):
            members, place = np.unique(text[chosen], return_inverse=True)
            out.append((serial, int(b), 0, _planes(name[chosen]), _planes(ids[members]), _steps(members),
                        _steps(place), _steps(begin[chosen]), b""))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _RUN_SCHEMA, strict=True)], schema=_RUN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows come from files, so a task that is run again makes the same packs.
        serial = TaskContext.get().partitionId() << 32
        held, n, n_texts = [], 0, 0
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc_id", "_row"))
            for some, data, offsets in _opened(batch.column("packed")):
                found = phrases(data, offsets)
                left, right = (_places(found, batch.column(c)[some]) for c in ("lefts", "rights"))
                middle = found.trigger - SIDE
                at = np.unique(np.concatenate([_stretches(found.low[left], np.minimum(found.high, middle)[left]), _stretches(np.maximum(found.low, middle)[right], found.high[right])]))
                bucket = (_named(data, at, _OTHER_BYTES) % np.uint64(buckets)).astype(np.int32)
                name = _named(data, at, _BYTES)
                text = np.searchsorted(offsets, at, side="right") - 1
                # A long text may lie in several packs.
                for s in range(0, len(at), PACK_RUNS):
                    t = text[s : s + PACK_RUNS]
                    held.append((t - t[0] + n_texts, at[s : s + PACK_RUNS] - offsets[t], bucket[s : s + PACK_RUNS], name[s : s + PACK_RUNS], ids[some][t[0] : t[-1] + 1], rows[some][t[0] : t[-1] + 1]))
                    n, n_texts = n + len(t), n_texts + int(t[-1] - t[0]) + 1
                    if n >= PACK_RUNS:
                        yield pack(serial, *map(np.concatenate, zip(*held, strict=True)))
                        serial, held, n, n_texts = serial + 1, [], 0, 0
        if n:
            yield pack(serial, *map(np.concatenate, zip(*held, strict=True)))

    return held.filter("size(lefts) + size(rights) > 0").select("_row", "doc_id", "packed", "lefts", "rights").mapInArrow(run, RUNS)


def _repeated_runs(table: pa.Table) -> pa.Table:
    """`pack, texts, begins, rows` of a bucket: the suffixes of each pack whose first MATCH_BYTES bytes a smaller document has.

    The suffixes of all packs are brought into one order by name; equal ones stand side by side, and the smallest document
    among them is the one to keep."""
    cells = [dict(zip(_RUN_FIELDS, r, strict=True)) for r in zip(*(table.column(c).to_pylist() for c in _RUN_FIELDS), strict=True)]
    out = [(c["pack"], c["texts"], c["begins"], c["rows"]) for c in cells if c["kind"] == 1]
    cells = [c for c in cells if c["kind"] == 0]
    if cells:
        places = [_from_steps(c["texts"]) for c in cells]
        name = np.concatenate([_from_planes(c["names"], np.uint64) for c in cells])
        doc = np.concatenate([_from_planes(c["docs"], np.int64)[p] for c, p in zip(cells, places, strict=True)])
        repeated = _later(doc, name)
        for c, place, mine in zip(cells, places, np.split(repeated, np.cumsum([len(p) for p in places])[:-1]), strict=True):
            if mine.any():
                text = _from_steps(c["members"])[place[mine]]
                out.append((c["pack"], _steps(text), _steps(_from_steps(c["begins"])[mine]), b""))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(zip(("pack", "texts", "begins", "rows"), kinds, strict=True))})


def _ranges(table: pa.Table) -> pa.Table:
    """`_row, begin, end` of a pack: the bytes under its repeated suffixes."""
    rows = next(np.frombuffer(r, dtype=np.int64) for r in table.column("rows").to_pylist() if r)
    text, begin = (np.concatenate([_from_steps(x) for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("texts", "begins"))
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (np.diff(begin) != 1)
    last = np.ones(len(text), dtype=bool)
    last[:-1] = new[1:]
    return pa.table({"_row": pa.array(rows[text[new]], pa.int64()), "begin": pa.array(begin[new], pa.int32()), "end": pa.array(begin[last] + MATCH_BYTES, pa.int32())})


def _cut(held: DataFrame) -> DataFrame:
    """`_row, n_removed, n_spans, kept, spans` from the phrases that are repeated as a whole and the ranges at the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ranges = batch.column("_row").to_pylist(), batch.column("ranges").to_pylist()
            out = [[], [], [], [], []]
            for some, data, offsets in _opened(batch.column("packed")):
                depth = np.zeros(len(data) + 1, dtype=np.int32)
                found = phrases(data, offsets)
                whole = _places(found, batch.column("wholes")[some])
                np.add.at(depth, found.low[whole], 1)
                np.add.at(depth, found.high[whole] + MATCH_BYTES, -1)
                for first, several in zip(offsets.tolist(), ranges[some], strict=False):
                    for r in several or ():
                        depth[first + r["begin"]] += 1
                        depth[first + r["end"]] -= 1
                all_gone = np.cumsum(depth[:-1]) > 0
                for row, a, b in zip(rows[some], offsets[:-1], offsets[1:], strict=True):
                    gone = all_gone[a:b]
                    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    begin, end = np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()
                    values = row, int(gone.sum()), len(begin), hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest(), [{"begin": x, "end": y} for x, y in zip(begin, end, strict=True)]
                    for have, value in zip(out, values, strict=True):
                        have.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["_row", "n_removed", "n_spans", "kept_sha256", "spans"])

    return held.select("_row", "packed", "wholes", "ranges").mapInArrow(run, "_row long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans` for every row of `docs`.

    A byte is removed when a run of MATCH_BYTES bytes over it also begins in a document with a smaller doc_id; `spans`
    are the removed ranges of bytes. Phrases that are whole repeats are known from the dictionary alone; only where a
    phrase shares its trigger and one side with another are suffixes compared. Phrases are told apart by 64 bits of
    content within the bucket and 32 bits of their trigger, suffixes by 64 bits of their first MATCH_BYTES bytes within
    a bucket that a second hash names. Null texts are empty, and texts under MATCH_BYTES bytes
    keep everything; so do rows without a doc_id, which give no other document a repeat either. Rows of one doc_id
    are never repeats of each other. An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_row", spread_key(F.col("doc_id"), F.col("text")))
    named = rows.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (20 * BUCKET_PHRASES)))
    marks = _packed(named, buckets).groupBy("bucket").applyInArrow(_marks, "_row long, number int, mark int")
    marks = marks.groupBy("_row").agg(
        F.collect_list(F.when(F.col("mark") == WHOLE, F.col("number"))).alias("wholes"),
        *[F.collect_list(F.when(F.col("mark").bitwiseAND(side) > 0, F.col("number"))).alias(name) for side, name in ((LEFT, "lefts"), (RIGHT, "rights"))],
    )
    held = pin(_compressed(named).join(marks, "_row"))
    n_edges = held.agg(F.coalesce(F.sum(F.size("lefts") + F.size("rights")), F.lit(0))).first()[0]
    runs = _runs(held, max(1, -(-n_edges * (SIDE + 1) // BUCKET_RUNS)))
    repeated = runs.groupBy("bucket").applyInArrow(_repeated_runs, "pack long, texts binary, begins binary, rows binary")
    ranges = repeated.groupBy("pack").applyInArrow(_ranges, "_row long, begin int, end int")
    ranges = pin(ranges).groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    cut = _cut(held.join(ranges, "_row", "left").filter("size(wholes) > 0 or ranges is not null")).dropDuplicates(["_row"])
    base = rows.select("_row", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    out = base.join(cut, "_row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"))
