"""Token sequences in training order as fixed-stride binary shards."""

from __future__ import annotations

import base64
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm.tokens import groups
from plantpulse.session import ensure_checkpoint_dir

#: A record: slot, sequence, tokens used, CRC-32 of the token bytes; the tokens, two bytes each; four closing bytes.
HEADER = "<QQII"
HEADER_BYTES = struct.calcsize(HEADER)
TRAILER = b"\0\0\0\n"
SEQUENCE_TOKENS = 1024
SHARD_SLOTS = 16_384
ROUNDS = 6
#: Texts of so many bytes are encoded together; a longer text is a group by itself.
GROUP_BYTES = 4_000_000


def stride(tokens: int = SEQUENCE_TOKENS) -> int:
    return HEADER_BYTES + 2 * tokens + len(TRAILER)


def _round_keys(key: int) -> list[np.uint64]:
    out, x = [], key & (2**64 - 1)
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(np.uint64(x))
    return out


def _feistel(x: np.ndarray, half: int, keys: list[np.uint64]) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        left, right = right, left ^ ((f >> np.uint64(32)) & mask)
    return (left << np.uint64(half)) | right


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each number below `n` in a keyed permutation of 0 .. n - 1.

    A Feistel network permutes the least even power of two that holds n; what lands at n or above walks on until it is
    below n, at most four steps on average.
    """
    x = np.asarray(x, dtype=np.uint64)
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    keys = _round_keys(key)
    out = _feistel(x, half, keys)
    while (over := out >= n).any():
        out[over] = _feistel(out[over], half, keys)
    return out.astype(np.int64)


class Encoder:
    """Byte-level BPE of a rank file; tokens of a text as little-endian 16-bit numbers, with an end token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        if self.end >= 2**16 or sys.byteorder != "little":
            raise ValueError("tokens are written as two little-endian bytes")
        self.encoding = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Bytes of each token.
        self.width = np.zeros(self.end, dtype=np.int64)
        self.width[list(ranks.values())] = list(map(len, ranks))

    def _encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str | None) -> bytes:
        return self._encode(text or "").astype("<u2").tobytes() + self.encoding_end()

    def encode_all(self, column: pa.Array) -> "Encoded":
        """The tokens of many texts, as `encode` gives them one by one, with each different piece looked up once.

        The pattern always parts a text before a space that stands before something else, so the pieces between such spaces can be
        encoded in any order: the different ones are one text, and the bytes of its tokens tell where a piece ends.
        Nothing is kept from one call to the next.
        """
        column = column.cast(pa.string()).fill_null("")
        loose = pc.match_substring_regex(column, _LOOSE_SPACE_RE2)
        split = pc.split_pattern(pc.if_else(loose, "", column), " ")
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        every = split.flatten()
        inner = np.ones(len(every), dtype=bool)
        inner[offsets[:-1]] = False
        # First pieces have no space before them: they, and whole texts that are not cut, are looked up by themselves.
        alone = pc.if_else(loose, column, every.take(pa.array(offsets[:-1])))
        own = [self._encode(text).astype("<u2") for text in alone.to_pylist()]
        pieces = every.filter(pa.array(inner)).dictionary_encode()
        found, size = self._pieces(pieces.dictionary)
        size = np.concatenate([size, np.fromiter(map(len, own), dtype=np.int64, count=len(own)), [1]])
        # One number per piece of a text: that of its first piece, those of the others, the end.
        order = np.empty(len(every) + len(column), dtype=np.int32)
        begin = offsets[:-1] + np.arange(len(column))
        last = begin + np.diff(offsets)
        middle = np.ones(len(order), dtype=bool)
        middle[begin] = middle[last] = False
        order[middle] = pieces.indices.to_numpy()
        order[begin] = len(pieces.dictionary) + np.arange(len(column))
        order[last] = len(size) - 1
        return Encoded(np.concatenate([found, *own, np.array([self.end], dtype="<u2")]), size, order, np.append(begin, len(order)))

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words that follow a space, one word behind the other, and how many each has."""
        if not len(words):
            return np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        found = self._encode(" " + text)
        ends = np.cumsum(self.width[found])
        stops = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(ends, stops)
        if ends[-1] != stops[-1] or (ends[last] != stops).any():
            raise RuntimeError("a token goes beyond the end of a piece")
        return found.astype("<u2"), np.diff(last, prepend=-1)

    def encoding_end(self) -> bytes:
        return struct.pack("<H", self.end)


@dataclass
class Encoded:
    """Tokens of texts as numbers of pieces: `found` are the tokens of all pieces, `size` how many each has, `order` the pieces of all
    texts, those of text i from `begin[i]` to `begin[i + 1]`."""

    found: np.ndarray
    size: np.ndarray
    order: np.ndarray
    begin: np.ndarray

    @property
    def total(self) -> int:
        return int(self.size[self.order].sum())

    def tokens(self) -> np.ndarray:
        """All tokens, one text behind the other."""
        first = np.cumsum(self.size) - self.size
        n = self.size[self.order]
        end = np.cumsum(n)
        return self.found[np.arange(end[-1] if len(end) else 0) + np.repeat(first[self.order] - (end - n), n)]


#: A space before white space or the end: the pattern may take it together with what follows. The white space is listed,
#: for a library that takes ASCII only.
_LOOSE_SPACE_RE2 = r" (?:[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\z)"
_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker and file; the default is the byte-level vocabulary of the public tokenizers."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        _encoders[path] = Encoder(path, public_tokenizers.PATTERN)
    return _encoders[path]


def _counts(docs: DataFrame, path: str | None) -> dict[int, tuple[int, int]]:
    """Tokens before each partition and in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(path).encode_all, 0
        for batch in batches:
            for begin, end in groups(batch["text"], GROUP_BYTES):
                total += encode(batch["text"].slice(begin, end - begin)).total
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([total], pa.int64())})

    before, at = {}, 0
    for part, n in sorted(map(tuple, docs.mapInArrow(run, "part int, n long").collect())):
        before[part] = (at, n)
        at += n
    return before


def write_shards(docs: DataFrame, folder: str, key: int = 20240229, tokens: int = SEQUENCE_TOKENS, slots: int = SHARD_SLOTS, path: str | None = None) -> dict:
    """Writes every token of `docs` once, in training order, and returns the manifest.

    The tokens of all texts, each followed by an end token, are one stream in the order in which the table is read. It
    is cut into sequences of `tokens`; only the last is filled up with end tokens. The keyed permutation gives each
    sequence its slot. Shard s holds slots s * slots up to the next shard's, one record of `stride(tokens)` bytes each, so slot i
    begins at byte (i % slots) * stride of shard i // slots. Spark's text writer commits the shards, so lost tasks leave
    nothing behind. Null and empty texts are an end token; repeated rows are written as often as they occur; an
    empty table gives no shard. Other columns are not looked at.

    `docs` has to be read from files: it is read twice, first to count the tokens of each partition, and a
    partition that differs the second time ends the job. What the driver holds is one count per partition.
    """
    docs = docs.select("text")
    before = _counts(docs, path)
    total = sum(n for _, n in before.values())
    sequences = -(-total // tokens)
    manifest = {"folder": folder, "tokens": total, "sequences": sequences, "sequence_tokens": tokens, "shard_slots": slots, "stride": stride(tokens), "key": key}
    if not sequences:
        return manifest

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        at, expected = before[TaskContext.get().partitionId()]
        last = at + expected
        for batch in batches:
            for begin, end in groups(batch["text"], GROUP_BYTES):
                own = encode(batch["text"].slice(begin, end - begin)).tokens()
                # Cut where a sequence ends.
                sequence = np.arange(at // tokens, -(-(at + len(own)) // tokens))
                cuts = np.clip(sequence * tokens, at, None)
                stops = np.append(cuts[1:], at + len(own))
                raw = own.tobytes()
                data = [raw[2 * a : 2 * b] for a, b in zip((cuts - at).tolist(), (stops - at).tolist(), strict=True)]
                slot = permuted(sequence.astype(np.uint64), sequences, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot // slots, pa.int64()), pa.array(slot, pa.int64()), pa.array(sequence, pa.int64()), pa.array(cuts % tokens, pa.int32()), pa.array(data, pa.binary())],
                                                 names=["shard", "slot", "sequence", "place", "data"])
                at += len(own)
        if at != last:
            raise RuntimeError("the table was not read in the same partitions again; hand in a table read from files")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<H", encoder(path).end)
        shard, slot, sequence, parts = -1, -1, -1, []

        def record() -> bytes:
            own = b"".join(parts)
            used = len(own) // 2
            own += end * (tokens - used)
            return struct.pack(HEADER, slot, sequence, used, zlib.crc32(own)) + own + TRAILER[:-1]

        for batch in batches:
            shards, out = [], []
            columns = [batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", "data")]
            for a, b, c, d in zip(*columns, strict=True):
                if b != slot and parts:
                    shards.append(shard)
                    out.append(record())
                    parts = []
                shard, slot, sequence = a, b, c
                parts.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(out, pa.binary())], names=["shard", "record"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([record()], pa.binary())], names=["shard", "record"])

    rows = docs.mapInArrow(pieces, "shard long, slot long, sequence long, place int, data binary")
    n_shards = -(-sequences // slots)
    rows = rows.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("slot", "place")
    # A shard is a task, so no sample of the rows is needed to part them. The writer takes the bytes of a string as they
    # are and closes each with the line end, the last byte of a record.
    written = rows.mapInArrow(records, "shard long, record binary").select("shard", F.col("record").cast("string").alias("value"))
    written.write.partitionBy("shard").option("lineSep", "\n").text(folder)
    return manifest


def read_records(spark: SparkSession, manifest: dict, first: int = 0, n: int | None = None) -> DataFrame:
    """`slot, sequence, n_tokens, crc32, whole, record` of the slots from `first` on, from the shards that hold them.

    `whole` tells whether the stored checksum is that of the tokens read. Slots are found by arithmetic, so a reader goes on
    where another stopped by asking for the next slot.
    """
    schema = "slot long, sequence long, n_tokens int, crc32 long, whole boolean, record binary"
    last = min(manifest["sequences"], first + (manifest["sequences"] if n is None else n)) - 1
    if last < first:
        return spark.createDataFrame([], schema)
    slots = manifest["shard_slots"]
    shards = ",".join(f"{manifest['folder']}/shard={s}/part-*" for s in range(first // slots, last // slots + 1))

    def parsed(record: bytes) -> tuple:
        slot, sequence, used, crc = struct.unpack_from(HEADER, record)
        return slot, sequence, used, crc, zlib.crc32(record[HEADER_BYTES : -len(TRAILER)]) == crc and record.endswith(TRAILER), bytes(record)

    # A split of the file ends between records, so shards are read in pieces.
    rows = spark.sparkContext.binaryRecords(shards, manifest["stride"]).map(parsed).toDF(schema)
    return rows.filter(F.col("slot").between(first, last))


def shard_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row per record as it stands in the files: `slot, sequence, shard, byte_offset, n_tokens, crc32, whole, sha256`."""
    rows = read_records(spark, manifest)
    slots = manifest["shard_slots"]
    return rows.select("slot", "sequence", F.expr(f"slot div {slots}").alias("shard"), ((F.col("slot") % slots) * manifest["stride"]).alias("byte_offset"),
                       "n_tokens", "crc32", "whole", F.sha2("record", 256).alias("sha256"))


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
