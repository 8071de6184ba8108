"""Vector columns: JVM-side expressions, and the Arrow view used by block steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(*columns: str) -> Column:
    """Numeric columns as one vector column."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def as_double(x: str | Column) -> Column:
    """Single-precision vectors are promoted once, at load."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def scale(x: Column, factors: list[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(f)) for f in factors]), lambda v, f: v * f)


def shift(x: Column, offsets: list[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(float(o)) for o in offsets]), lambda v, o: v - o)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as an (n, d) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vectors must not be NULL; drop or fill them at load")
    if pa.types.is_binary(column.type):  # blocks of ``packed_rows``
        return np.concatenate([np.frombuffer(v.as_buffer(), np.float64, offset=8).reshape(-1, int.from_bytes(v.as_buffer()[:8].to_pybytes(), "little")) for v in column])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def packed_rows(values: np.ndarray, rows: int) -> pa.Array:
    """An (n, d) array as blocks of ``rows`` vectors, each a binary value: the dimension, then the numbers."""
    head = values.shape[1].to_bytes(8, "little")
    return pa.array([head + np.ascontiguousarray(values[at : at + rows]).tobytes() for at in range(0, len(values), rows)], pa.binary())


def vector_array(values: np.ndarray) -> pa.Array:
    """An (n, d) array as an Arrow list column."""
    n, d = values.shape
    offsets = np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise squared distances, exact zero for equal rows."""
    if a.shape[1] <= 8 or a.shape[0] * b.shape[0] * a.shape[1] <= 4_000_000:
        out = np.zeros((a.shape[0], b.shape[0]))
        for j in range(a.shape[1]):
            apart = np.subtract.outer(a[:, j], b[:, j])
            apart *= apart
            out += apart
        return out
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    # cancellation hurts close pairs only: recompute those directly
    near = np.argwhere(out <= 1e-6 * ((a * a).sum(1).max(initial=0.0) + 1e-300))
    for lo in range(0, len(near), 65536):
        i, j = near[lo : lo + 65536].T
        out[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.maximum(out, 0.0)


def close_pairs(a: np.ndarray, b: np.ndarray, limit, tile: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(at, i, j, squared distance) of the pairs a[at + i], b[j] whose squared distance is at most ``limit`` (one, or one for each row of ``a``).

    A product in single precision leaves out what is farther by more than its rounding; the rest is measured by differences.
    """
    limit = np.broadcast_to(np.asarray(limit, np.float64), (len(a),))
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    top = max(aa.max(initial=0.0), bb.max(initial=0.0))
    quick = a.shape[1] > 8 and len(a) * len(b) * a.shape[1] > 4_000_000 and 1e-20 < top < 1e20
    if quick:
        # |a - b|^2 <= limit as a row of one product: b.b - 2 a.b <= limit - a.a
        wide = np.concatenate([b * -2.0, bb[:, None]], axis=1).astype(np.float32).T.copy()
        room = 5e-7 * (a.shape[1] + 8) * top
    for at in range(0, len(a), tile):
        rows, most = a[at : at + tile], limit[at : at + tile]
        if quick:
            some = np.concatenate([rows, np.ones((len(rows), 1))], axis=1).astype(np.float32) @ wide
            i, j = np.nonzero(some <= (most - aa[at : at + tile] + room).astype(np.float32)[:, None])
            parts = [((rows[i[lo : lo + 65536]] - b[j[lo : lo + 65536]]) ** 2).sum(1) for lo in range(0, len(i), 65536)]
            D = np.concatenate([np.empty(0), *parts])
            ok = D <= most[i]
            yield at, i[ok], j[ok], D[ok]
        else:
            D = square_distances(rows, b)
            i, j = np.nonzero(D <= most[:, None])
            yield at, i, j, D[i, j]


def true_places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``nonzero`` of a flat table of few True cells, looking at eight cells at once."""
    if mask.shape[1] % 8 or not mask.flags.c_contiguous:
        return np.nonzero(mask)
    words = np.flatnonzero(mask.ravel().view(np.uint64) != 0)
    at = np.flatnonzero(mask.reshape(-1, 8).take(words, 0))
    return np.divmod(words[at >> 3] * 8 + (at & 7), mask.shape[1])


def measured_pairs(a: np.ndarray, b: np.ndarray, limit: float, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of the pairs of rows whose squared distance is at most ``limit``, by rising i.

    The distance is always summed from the differences of the two rows, so a pair has the same one wherever it is met.
    """
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    top = max(aa.max(initial=0.0), bb.max(initial=0.0))
    quick = a.shape[1] > 8 and 1e-20 < top < 1e20
    if quick:
        wide = np.concatenate([b * -2.0, bb[:, None]], axis=1).astype(np.float32).T.copy()
        room = 5e-7 * (a.shape[1] + 8) * top
    else:
        tile = max(1, min(tile, 2_000_000 // max(1, b.size)))
    for at in range(0, len(a), tile):
        rows = a[at : at + tile]
        if quick:
            some = np.concatenate([rows, np.ones((len(rows), 1))], axis=1).astype(np.float32) @ wide
            i, j = true_places(some <= (limit - aa[at : at + tile] + room).astype(np.float32)[:, None])
            d = np.empty(len(i))
            for lo in range(0, len(i), 4096):
                apart = rows.take(i[lo : lo + 4096], 0, mode="clip")
                apart -= b.take(j[lo : lo + 4096], 0, mode="clip")
                apart *= apart
                d[lo : lo + 4096] = apart.sum(1)
            ok = d <= limit
            yield at + i[ok], j[ok], d[ok]
        else:
            d = ((rows[:, None] - b[None]) ** 2).sum(2)
            i, j = np.nonzero(d <= limit)
            yield at + i, j, d[i, j]
