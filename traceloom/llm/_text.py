"""Vectorised work on whole Arrow batches of text: words, rolling hashes and window anchors.

Everything here takes several documents laid end to end as one array and treats their borders
exactly, so that one numpy call serves about a megabyte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One random 64-bit value for each byte value.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        for i, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any span of `values` (uint64) in constant time a span."""

    def __init__(self, values: np.ndarray):
        self.inverse = _power(len(values) + 1)[1]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power(len(values))[0], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length)) if n else np.zeros(0, np.uint64)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about `limit` bytes; a longer text is a run of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the maximal runs without ASCII white space, and where each document's words begin."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    step = solid[1:] != solid[:-1]
    border = offsets[1:-1]
    # A word that touches a document's border ends there, and the next one starts there.
    both = border[solid[border] & solid[border + 1]]
    both = np.unique(both[(both > 0) & (both < len(data))])
    edges = np.flatnonzero(step)
    starts, ends = edges[0::2], edges[1::2]
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).spans(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (running minima from both ends of blocks of w)."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    pad = -len(a) % w
    blocks = np.concatenate([a, np.full(pad, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


_BITS = np.uint64(22)


def anchor_runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that share their anchor, the least gram (leftmost of equals) in the window.

    Two equal windows have the same anchor at the same distance, wherever they stand, so all windows
    that can be equal meet under one anchor. Returns document, first window (within the document),
    number of windows, distance of the anchor from the first window, and the anchor's hash.
    """
    out, most = [], (1 << int(_BITS)) - window
    for lo in range(0, max(1, len(values) - window + 1), most):
        part = values[lo : lo + most + window - 1]
        n = len(part) - window + 1
        if n <= 0:
            continue
        grams = Rolling(part).windows(gram)
        at = sliding_min((grams >> _BITS << _BITS) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        at = (at & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)[:n]
        x = np.arange(lo, lo + n)
        doc = np.searchsorted(offsets, x, "right") - 1
        inside = x + window <= offsets[doc + 1]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        keep = inside[first]
        first, count = first[keep], count[keep]
        out.append((doc[first], x[first] - offsets[doc[first]], count, at[first] - first, grams[at[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, np.minimum(starts, n), 1)
    np.add.at(depth, np.minimum(ends, n), -1)
    return np.cumsum(depth[:n]) > 0
