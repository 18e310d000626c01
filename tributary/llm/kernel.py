"""Vectorised text primitives over Arrow string columns: words, word hashes, shingle hashes.

Texts are handled as the UTF-8 bytes of a whole Arrow column, in blocks of a few MB, so that a task's memory is bounded
by the block or by its longest text. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LANES = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: white space, or everything in ASCII but digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about limit bytes; a longer text is a block of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of consecutive texts: byte ranges, and the first word of each text in ``first`` (len + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.low = LOWER[data]
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        self.starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        self.ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        self.first = np.searchsorted(self.starts, off)

    def hashes(self, limit: int = BLOCK_BYTES) -> np.ndarray:
        """64-bit hashes of the words, from running sums over at most ``limit`` bytes at a time."""
        found = np.zeros(len(self.starts), np.uint64)
        lo, n = 0, len(self.starts)
        while lo < n:
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + limit, "right")))
            if self.ends[hi - 1] - base > limit:
                found[lo] = self._long(int(base), int(self.ends[lo]), limit)
            else:
                data = self.low[base : self.ends[hi - 1]]
                power, inverse = _power_tables(len(data) + 1)
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data + np.uint64(1)) * power[: len(data)], out=total[1:])
                start, end = self.starts[lo:hi] - base, self.ends[lo:hi] - base
                found[lo:hi] = (total[end] - total[start]) * inverse[start]
            lo = hi
        return mix(found + (self.ends - self.starts).astype(np.uint64) * _LANES[0])

    def _long(self, start: int, end: int, limit: int) -> int:
        """The sum of one word longer than ``limit`` bytes, piece by piece."""
        total, power = 0, _power_tables(limit)[0]
        for at in range(start, end, limit):
            data = self.low[at : min(at + limit, end)]
            part = int(((data + np.uint64(1)) * power[: len(data)]).sum(dtype=np.uint64))
            total += part * pow(int(_P), at - start, 1 << 64)
        return total & ((1 << 64) - 1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; fewer words than ``width`` are one shingle."""
    lanes = [np.uint64(pow(int(_LANES[j % 5]), j // 5 + 1, 1 << 64) | 1) for j in range(width)]
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + n] * lanes[j]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            short = sum((int(h) * int(k) for h, k in zip(hashes[lo:hi], lanes, strict=False)), start=(hi - lo) << 56)
            out.append(mix(np.array([short & ((1 << 64) - 1)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> list[np.ndarray]:
    data, off = utf8(column)
    out: list[np.ndarray] = []
    for lo, hi in blocks(off):
        part = off[lo : hi + 1]
        words = Words(data[part[0] : part[-1]], part - part[0])
        out += shingles(words.hashes(), words.first, width)
    return out
