"""Fill-in-middle: documents cut into prefix, middle and suffix at unit boundaries, and put together in another order.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. The texts of an
Arrow batch lie behind one another in fixed blocks of bytes. A Fenwick tree over the blocks holds how many units end and
how many code points begin in each; a binary-lifting descent for all cuts at once finds the block of each cut, and only
those blocks are looked into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import tokens
from plantpulse.llm.arrow import map_rows

#: Bytes in a block.
BLOCK = 256
#: Texts of so many bytes are worked on together; a longer text is a group by itself.
GROUP_BYTES = 4_000_000

SEED = 42
#: Of 100 documents so many are cut, and of 100 cut ones so many begin with the suffix.
CUT_PERCENT, SPM_PERCENT = 50, 80
#: Marks of the parts; texts that hold one of them stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Fenwick:
    """Prefix sums over blocks: node i (from 1) holds the sum of the `i & -i` blocks that end with block i."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts, dtype=np.int64)])
        node = np.arange(1, self.n + 1)
        self.tree = np.concatenate([np.zeros(1, dtype=np.int64), total[node] - total[node - (node & -node)]])

    def before(self, block: np.ndarray) -> np.ndarray:
        """Sum of all blocks before each block (numbered from 0)."""
        at, out = block.astype(np.int64), np.zeros(len(block), dtype=np.int64)
        while at.any():
            out += self.tree[at]
            at = at & (at - 1)
        return out

    def find(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block (from 0) that holds the rank-th item (from 1), and the rank inside it."""
        at, left = np.zeros(len(rank), dtype=np.int64), rank.astype(np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            to = at + step
            # A node beyond the end is as good as one that is too large.
            size = np.where(to <= self.n, self.tree[np.minimum(to, self.n)], np.iinfo(np.int64).max)
            down = size < left
            at, left = np.where(down, to, at), np.where(down, left - size, left)
            step >>= 1
        return at, left


@dataclass
class Units:
    """The unit ends of the texts of a group, in blocks."""

    data: np.ndarray
    offsets: np.ndarray
    ends: np.ndarray  # whether a unit ends with this byte, padded to whole blocks
    points: np.ndarray  # whether a code point begins with this byte, padded likewise
    unit_tree: Fenwick
    point_tree: Fenwick

    def _at_byte(self, flags: np.ndarray, tree: Fenwick, byte: np.ndarray) -> np.ndarray:
        """Flags set before each byte position."""
        block = byte // BLOCK
        inside = np.arange(BLOCK)[None, :] < (byte % BLOCK)[:, None]
        padded = np.minimum(block, max(len(flags) // BLOCK - 1, 0))
        rows = flags.reshape(-1, BLOCK)[padded] if len(flags) else np.zeros((len(byte), BLOCK), dtype=bool)
        return tree.before(block) + (rows & inside & (block < len(flags) // BLOCK)[:, None]).sum(axis=1)

    def units_before(self, byte: np.ndarray) -> np.ndarray:
        return self._at_byte(self.ends, self.unit_tree, byte)

    def points_before(self, byte: np.ndarray) -> np.ndarray:
        return self._at_byte(self.points, self.point_tree, byte)

    def end_of(self, rank: np.ndarray) -> np.ndarray:
        """Byte position behind the rank-th unit (from 1) of the group."""
        block, left = self.unit_tree.find(rank)
        inside = np.cumsum(self.ends.reshape(-1, BLOCK)[block], axis=1)
        return block * BLOCK + (inside >= left[:, None]).argmax(axis=1) + 1


def units(column: pa.Array) -> Units:
    data, offsets = tokens.text_bytes(column)
    n = len(data)
    solid = ~tokens._IS_SPACE[data]
    last = np.zeros(n, dtype=bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    following = np.zeros(n, dtype=bool)
    following[:-1] = solid[1:]
    padding = np.zeros(-n % BLOCK, dtype=bool)
    ends = np.concatenate([last | (solid & ~following), padding])
    points = np.concatenate([(data & 0xC0) != 0x80, padding])
    per_block = [Fenwick(x.reshape(-1, BLOCK).sum(axis=1)) for x in (ends, points)]
    return Units(data, offsets, ends, points, *per_block)


def _draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from the id; without an id those of the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def form_of(text: Column, doc_id: Column) -> Column:
    _, _, cut, order = _draws(doc_id)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (cut % 100 >= CUT_PERCENT)
    return F.when(plain, "plain").when(order % 100 < SPM_PERCENT, "spm").otherwise("psm")


def _cut(batch: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {"_doc": batch["_doc"], "n": [], "form": batch["form"], "prefix_chars": [], "middle_chars": [], "output": []}
    forms = np.array(batch["form"].to_pylist(), dtype=object)
    for begin, end in tokens.groups(batch["_text"], GROUP_BYTES):
        made = units(batch["_text"].slice(begin, end - begin))
        before = made.units_before(made.offsets)
        n = np.diff(before)
        draw = np.stack([batch[c].slice(begin, end - begin).to_numpy() for c in ("_h1", "_h2")]) % (n + 1)
        at = []
        for k in (draw.min(axis=0), draw.max(axis=0)):
            where = made.offsets[:-1].copy()
            some = np.flatnonzero(k)
            where[some] = made.end_of(before[:-1][some] + k[some])
            at.append(where)
        points = [made.points_before(x) for x in (made.offsets[:-1], *at)]
        cut = forms[begin:end] != "plain"
        out["n"] += n.tolist()
        for name, a, b in (("prefix_chars", 0, 1), ("middle_chars", 1, 2)):
            out[name] += [x if c else None for x, c in zip((points[b] - points[a]).tolist(), cut, strict=True)]
        raw = made.data.tobytes()
        for form, a, p, m, b in zip(forms[begin:end], made.offsets[:-1].tolist(), at[0].tolist(), at[1].tolist(), made.offsets[1:].tolist(), strict=True):
            prefix, middle, suffix = raw[a:p], raw[p:m], raw[m:b]
            if form == "plain":
                text = raw[a:b]
            elif form == "psm":
                text = b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))
            else:
                text = b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
            out["output"].append(text.decode())
    return out


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` for every row of `docs` (columns `doc_id, text`, others unread).

    A null text is empty; an empty text has no units and stays plain, as does one that holds a mark. A null id draws as
    the empty text. Rows are independent: repeated rows give repeated results, an empty table an empty one. The parts of
    a plain document have no lengths.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, _, _ = _draws(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").alias("_doc"), text.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), form_of(text, F.col("doc_id")).alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_doc {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_rows(rows, schema, _cut).withColumnRenamed("_doc", "doc_id")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with marks are plain, so the first mark of each kind is the right one."""
    first = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    until = lambda x, mark: F.call_function("substring_index", x, mark, F.lit(1))
    one = until(body, first)
    rest = F.substr(body, F.length(one) + len(PREFIX) + 1)
    two = until(rest, F.lit(MIDDLE))
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
