"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about so many bytes; one longer text is a group by itself.
GROUP_BYTES = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, n - 1).bit_length(), base, dtype=np.uint64) if n < 1 << 16 else np.full(n + (n >> 2), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `size` bytes together."""
    if len(column) == 0:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(ends, ends[begin] + size, side="right")) - 1
        end = min(len(column), max(end, begin + 1))
        yield begin, end
        begin = end


@dataclass
class Words:
    """Word hashes of a group of texts; `first[i]:first[i + 1]` are those of text i."""

    hashes: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; null texts are empty."""
    column = column.fill_null("").cast(pa.string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> Words:
    """Words are runs without space and the controls 9 to 13; A-Z count as a-z."""
    data, offsets = text_bytes(column)
    n = len(data)
    if n == 0:
        return Words(np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    solid = ~_IS_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(_LOWER_BYTE[data], powers(n), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(n, _INVERSE)[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets))
