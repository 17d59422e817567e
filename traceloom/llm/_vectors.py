"""Vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length of the column embedding, the greater of several; 1 if there is none."""
    first = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 1


def matrix(column: pa.Array, dim: int, zeros: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows as float64 and which of them count: `dim` finite components, not all zero unless `zeros`."""
    n = len(column)
    values = np.zeros((n, dim))
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = np.asarray(column.offsets).astype(np.int64)
    size = np.diff(offsets)
    good = (size == dim) & ~np.asarray(column.is_null())
    flat = column.values
    if flat.null_count:
        bad = np.asarray(flat.is_null()).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(bad)])
        good &= total[offsets[1:]] == total[offsets[:-1]]
    flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if good.any():
        values[good] = flat[offsets[:-1][good][:, None] + np.arange(dim)]
    good &= np.isfinite(values).all(axis=1) & (zeros | (values != 0).any(axis=1))
    return values, good


def rows(raw: list[bytes] | np.ndarray, dim: int) -> np.ndarray:
    """Vectors kept as little-endian float64 bytes."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)


def paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs a[i], b[j], each summed in the order of the components, so that equal
    vectors get equal products wherever they stand."""
    out = np.zeros(len(i))
    for k in range(a.shape[1]):
        out += a[i, k] * b[j, k]
    return out


def whole(column: pa.Array, dim: int, scale: int = 256) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """floor(scale * x) of each component of the rows that count (zero rows too) as little-endian integers, of two bytes where
    all fit, else of eight; which rows count; the lengths of these integer vectors. Beyond 64 bits integers stay at the end."""
    values, good = matrix(column, dim, zeros=True)
    high = np.floor(values[good] * scale)
    small = (np.abs(high) < 1 << 15).all(axis=1)
    with np.errstate(invalid="ignore"):
        long = np.where(high >= 2.0**63, np.iinfo(np.int64).max, np.maximum(high, -(2.0**63)).astype(np.int64))
    packed = [(v.astype("<i2") if s else v).tobytes() for v, s in zip(long.astype("<i8"), small.tolist(), strict=True)]
    return packed, good, np.sqrt((high * high).sum(axis=1))


def whole_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Integer vectors of `whole` as int64."""
    short = np.array([len(v) == 2 * dim for v in raw], bool)
    out = np.empty((len(raw), dim), np.int64)
    for kind, mine in (("<i2", np.flatnonzero(short)), ("<i8", np.flatnonzero(~short))):
        out[mine] = np.frombuffer(b"".join(raw[i] for i in mine.tolist()), kind).reshape(-1, dim)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact where they fit a long. Sums under 2^53 are exact in double precision too."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if top(a) * top(b) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
