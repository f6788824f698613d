"""Benchmark decontamination with spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plantpulse.llm.tokens import Words, groups, mix, words

#: Words at a 1 are compared, words at a 0 are ignored, so one changed word leaves some seed unharmed.
MASKS = ("110110110101", "101011011011", "111010010111", "110100111011")
SPAN = 12
#: Items with fewer words than this can't be told from chance and match nothing; items shorter than a mask are
#: compared as a whole.
MIN_ITEM_WORDS = 5
#: An overlap counts when it has so many equal words (or all of a shorter item), and this share of its words is equal.
MIN_EQUAL = 12
MIN_IDENTITY = 0.8
#: A changed word inside an overlap costs as much as so many equal ones add.
CHANGE_COST = 2
#: Benchmark items are handed to the tasks in blocks of at most about so many words; each block passes over all rows.
BLOCK_WORDS = 1_000_000


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """One key for every window of the mask's length."""
    n = len(hashes) - len(mask) + 1
    key = np.full(max(0, n), int(mask, 2) + (len(mask) << 32), dtype=np.uint64)
    for j, used in enumerate(mask):
        if used == "1" and n > 0:
            key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(key)


class Block:
    """Seeds of some benchmark items: for every key the items and positions where it occurs."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.hashes = [h for _, h in items]
        self.masks = [*MASKS, *sorted({"1" * len(h) for h in self.hashes if MIN_ITEM_WORDS <= len(h) < SPAN})]
        keys, item, at = [], [], []
        for i, h in enumerate(self.hashes):
            for mask in self.masks if len(h) >= MIN_ITEM_WORDS else ():
                if len(h) == len(mask) or (len(h) >= SPAN and len(mask) == SPAN):
                    own = _seeds(h, mask)
                    keys.append(own)
                    item.append(np.full(len(own), i))
                    at.append(np.arange(len(own)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int64)
        self.bits = max(20, int(len(self.keys)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self.keys >> np.uint64(64 - self.bits)] = True

    def overlaps(self, text: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, equal words) of the best overlap of each row and item."""
        hits = set()
        for mask in self.masks:
            keys = _seeds(text.hashes, mask)
            at = np.flatnonzero(self.table[keys >> np.uint64(64 - self.bits)])
            low, high = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
            rows = np.searchsorted(text.first, at, "right") - 1
            for p, a, b, row in zip(at[high > low], low[high > low], high[high > low], rows[high > low], strict=True):
                if p + len(mask) <= text.first[row + 1]:
                    hits.update((int(row), int(self.item[k]), int(p - self.at[k])) for k in range(a, b))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, diagonal in hits:
            found = self._overlap(text, row, item, diagonal)
            if found and found[2] > best.get((row, item), (0, 0, 0))[2]:
                best[row, item] = found
        for (row, item), found in sorted(best.items()):
            yield row, item, *found

    def _overlap(self, text: Words, row: int, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """The best run of words on a diagonal, where a changed word costs and an equal one adds."""
        own, begin, end = self.hashes[item], text.first[row], text.first[row + 1]
        low, high = max(begin, diagonal), min(end, diagonal + len(own))
        equal = text.hashes[low:high] == own[low - diagonal : high - diagonal]
        total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -CHANGE_COST))])
        gain = total - np.minimum.accumulate(total)
        to = int(np.argmax(gain))
        since = int(np.argmin(total[: to + 1]))
        n = int(equal[since:to].sum())
        if n < min(MIN_EQUAL, len(own)) or n < MIN_IDENTITY * (to - since):
            return None
        return int(low + since - begin), to - since, n


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items of the benchmark in blocks of bounded size; null texts have no words."""
    size = F.length(F.coalesce("text", F.lit("")))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // (2 * block_words)))
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(parts))
    for k in range(parts):
        rows = benchmark.filter(part == k).select("item_id", "text").toArrow()
        text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        found = words(text.cast(pa.string()))
        yield Block([(i, found.hashes[found.first[r] : found.first[r + 1]]) for r, i in enumerate(rows.column("item_id").to_pylist())])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, first_word, n_words, n_equal`: one row per row of `docs` and benchmark item found in it.

    Positions count words of the text. Items meet texts where a seed of one is a seed of the other; the words around the
    hit are then compared one by one. Null and empty texts and items match nothing; repeated rows give repeated results;
    empty tables give an empty result. Other columns are not looked at.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, n_words long, n_equal long"
    rows = docs.select("doc_id", "text")

    def search(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, ids = batch.column("text"), batch.column("doc_id")
                for begin, end in groups(text):
                    found = list(block.overlaps(words(text.slice(begin, end - begin))))
                    if found:
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": ids.take(pa.array([begin + f[0] for f in found])),
                            "item_id": pa.array([block.ids[f[1]] for f in found], type=item_type),
                            **{name: pa.array([f[i] for f in found], type=pa.int64()) for i, name in ((2, "first_word"), (3, "n_words"), (4, "n_equal"))},
                        })

        return run

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    return reduce(DataFrame.unionByName, [rows.mapInArrow(search(b), schema) for b in blocks(benchmark)])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found, in the columns of `docs`.

    Null and empty texts hold no item and stay, as do all rows when the benchmark is empty; null items match nothing.
    Repeated rows stay or go together, and an empty table gives an empty one.
    """

    def keep(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, stays = batch.column("text"), np.ones(batch.num_rows, dtype=bool)
                for begin, end in groups(text):
                    for row, *_ in block.overlaps(words(text.slice(begin, end - begin))):
                        stays[begin + row] = False
                yield batch.filter(pa.array(stays))

        return run

    return reduce(lambda rows, block: rows.mapInArrow(keep(block), docs.schema), blocks(benchmark), docs)
