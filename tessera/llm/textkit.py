"""Vectorised work on the bytes of whole texts, one Arrow batch after another.

Texts are taken straight from Arrow's buffers. A batch is cut into pieces of about ``PIECE`` bytes (never inside
a text), so the arrays that hold eight bytes for each byte of text stay small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5


class _Cache(dict):
    """Arrays that each process makes for itself: they stay behind when code is shipped by value."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(n: int, name: str = "byte", base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse modulo 2**64."""
    if len(_powers.get((name, 1), ())) <= n:
        size = max(PIECE * 2 if name == "byte" else PIECE // 2, 1 << int(n).bit_length())
        for way in (1, -1):
            steps = np.full(size + 1, pow(base, way, 2**64), np.uint64)
            steps[0] = 1
            _powers[name, way] = np.multiply.accumulate(steps)
    return _powers[name, 1][: n + 1], _powers[name, -1][: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its texts; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``most`` bytes in column ``text``, with its bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Prefix:
    """Hashes of any byte ranges of a piece, by differences of prefix sums."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _power(len(data))
        codes = _CODES[LOWER] if lower else _CODES
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` within each text, and where each text's runs begin."""
    n = len(inside)
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside one text, by window start, and whether a window starts there."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= k:
        up, down = _power(n, "word", 0xD6E8FEB86659FD93)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * down[:n], out=sums[1:])
        out[: n - k + 1] = mixed((sums[k:] - sums[: n - k + 1]) * up[k - 1 : n])
        ok[: n - k + 1] = True
        for j in range(1, k):  # windows that reach over the end of a text
            ends = first[1:] - j
            ok[ends[(ends >= 0) & (ends < n) & (ends >= first[:-1])]] = False
    return out, ok


def of_text(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
