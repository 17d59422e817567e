"""Texts of Arrow batches as rows of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def letters(column: pa.Array, right: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row of its own, 0 behind its end (`right`: before its beginning), and the lengths. Nulls count as
    empty. ASCII texts take a byte a symbol."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, n + 1, 8 * column.offset)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    if flat.max(initial=0) > 127:
        texts = column.to_pylist()
        size = np.fromiter(map(len, texts), np.int64, n)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    wide = int(size.max(initial=0))
    out = np.zeros((n, wide), flat.dtype)
    out[np.arange(wide) >= wide - size[:, None] if right else np.arange(wide) < size[:, None]] = flat
    return out, size


def texts(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts of these sizes from ASCII bytes that stand one after the other."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype(np.uint8).tobytes())).cast(pa.string())


_DIGIT = np.full(256, 4, np.uint8)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def cut_rows(shown: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of these rows of code points, from a place on and of a size, as rows of code points and lengths."""
    places = np.arange(int(size.max(initial=0)))
    out = shown[row[:, None], np.minimum(at[:, None] + places, max(shown.shape[1] - 1, 0))]
    out[places >= size[:, None]] = 0
    return out, size


def packed_rows(shown: np.ndarray, size: np.ndarray) -> pa.Array:
    """Texts as bytes: of up to 255 of A, C, G and T the length and a byte for four symbols; of others 0 and UTF-8."""
    n, wide = shown.shape
    digit = _DIGIT[shown] if shown.dtype == np.uint8 else np.where(shown < 256, _DIGIT[shown & 255], 4).astype(np.uint8)
    within = np.arange(wide) < size[:, None]
    plain = ((digit < 4) | ~within).all(axis=1) & (size > 0) & (size < 256)
    four = np.zeros((n, -(-wide // 4) * 4), np.uint8)
    four[:, :wide] = np.where(within, digit & 3, 0)
    four = four.reshape(n, -1, 4)
    body = np.concatenate([(size & 255).astype(np.uint8)[:, None], four[..., 0] << 6 | four[..., 1] << 4 | four[..., 2] << 2 | four[..., 3]], axis=1)
    if plain.all():
        keep = np.arange(body.shape[1]) <= -(-size[:, None] // 4)
        ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body[keep].tobytes())])
    text = lambda i: shown[i, : size[i]].astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([body[i, : 1 - (-size[i] // 4)].tobytes() if plain[i] else b"\0" + text(i).encode() for i in range(n)], pa.binary())


def packed(column: pa.Array) -> pa.Array:
    return packed_rows(*letters(column))


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What `letters` gives of texts that were packed."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at, flat = np.frombuffer(at, np.int64, n + 1, 8 * column.offset), np.frombuffer(data, np.uint8)
    size = flat[at[:-1]].astype(np.int64)
    four = -(-int(size.max(initial=0)) // 4)
    body = flat[np.minimum(at[:-1, None] + 1 + np.arange(four), len(flat) - 1)]
    out = np.frombuffer(b"ACGT", np.uint8)[np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=2).reshape(n, -1)]
    out[np.arange(out.shape[1]) >= size[:, None]] = 0
    if (size > 0).all():
        return out[:, : int(size.max())], size
    return letters(pa.array([x[1:].decode() if x[0] == 0 else out[i, : size[i]].tobytes().decode() for i, x in enumerate(column.to_pylist())]))
