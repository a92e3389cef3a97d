"""Vectors in Arrow batches: which are usable, their narrowest exact encoding, sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIM = 512
SKETCH_BITS = 768
INT8, HALF, FULL = 0, 1, 2


def usable_matrix(col: pa.Array | pa.ChunkedArray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column and their float32 matrix.

    Usable: exactly ``dim`` values, none null, all finite, not all zero.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros((0, dim), dtype=np.float32)
    off = col.offsets.to_numpy()
    ok = (np.diff(off) == dim) & col.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    vals = col.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if len(at) == 0:
        return at, np.zeros((0, dim), dtype=np.float32)
    x = vals[off[at][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], np.ascontiguousarray(x[good])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no length over- or underflows."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y


def pack(x: np.ndarray) -> list[bytes]:
    """Each float32 row in its narrowest exact form: fixed point in 8 bits, half floats, or floats."""
    if len(x) == 0:
        return []
    top = np.abs(x).max(axis=1)
    exp = np.clip(np.floor(np.log2(127.0 / top)), -100, 100).astype(np.int32)
    y = np.ldexp(x.astype(np.float64), exp[:, None])
    fixed = (y == np.rint(y)).all(axis=1) & (np.abs(y) <= 127).all(axis=1)
    with np.errstate(over="ignore"):
        h = x.astype(np.float16)
    half = (h.astype(np.float32) == x).all(axis=1) & ~fixed
    q = y.clip(-127, 127).astype(np.int8)
    out: list[bytes] = []
    for i in range(len(x)):
        if fixed[i]:
            out.append(bytes((INT8, int(exp[i]) + 128)) + q[i].tobytes())
        elif half[i]:
            out.append(bytes((HALF, 0)) + h[i].tobytes())
        else:
            out.append(bytes((FULL, 0)) + x[i].tobytes())
    return out


def unpack(col: pa.Array | pa.ChunkedArray, dim: int = DIM) -> np.ndarray:
    """The float64 rows that pack() was given."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = col.to_pylist()
    out = np.empty((len(rows), dim), dtype=np.float64)
    kinds = np.fromiter((r[0] for r in rows), dtype=np.uint8, count=len(rows))
    for kind, typ in ((INT8, np.int8), (HALF, np.float16), (FULL, np.float32)):
        at = np.flatnonzero(kinds == kind)
        if len(at):
            v = np.frombuffer(b"".join(rows[i][2:] for i in at), dtype=typ).reshape(len(at), dim).astype(np.float64)
            if kind == INT8:
                e = np.fromiter((rows[i][1] for i in at), dtype=np.int32, count=len(at)) - 128
                v = np.ldexp(v, -e[:, None])
            out[at] = v
    return out


def rotation(dim: int = DIM, bits: int = SKETCH_BITS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits)).astype(np.float32)


def sketches(x32: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Signs of random projections, as rows of uint64 words."""
    return np.packbits(x32 @ rot > 0, axis=1).view(np.uint64)


def exact_cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine of unit rows, the same for a pair wherever it is computed."""
    return np.round((a * b).sum(axis=1), 12)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions is joined to."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new
