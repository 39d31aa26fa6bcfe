"""Small numpy helpers used inside tasks, on one Arrow batch or on one bounded node."""

from __future__ import annotations

import numpy as np

# Relative cut on singular values taken from a scatter matrix (its eigenvalues carry half the digits).
SCATTER_TOL = 1e-7
# Relative cut on singular values of a direct decomposition.
DIRECT_TOL = 1e-9


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


def comparable(d2: np.ndarray) -> np.ndarray:
    """Keep 12 significant digits, so that summation order cannot decide a tie."""
    mag = np.floor(np.log10(np.where(d2 > 0, d2, 1.0)))
    unit = 10.0 ** (11.0 - mag)
    return np.round(d2 * unit) / unit


def sides(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """0 where ``left`` is as near as ``right`` or nearer, else 1.

    One product against the separating plane decides; rows too close to the plane for that
    are settled by their two distances.
    """
    w = right - left
    cut = float((left + right) @ w) / 2.0
    score = x @ w
    out = (score > cut).astype(np.int64)
    near = np.flatnonzero(np.abs(score - cut) <= 1e-9 * (np.abs(score) + abs(cut)))
    if near.size:
        d0, d1 = squared_distances(x[near], left), squared_distances(x[near], right)
        out[near] = d1 < d0
    return out


def farthest(x: np.ndarray, ids: np.ndarray, c: np.ndarray) -> int:
    """Row farthest from ``c``; among equals the smallest id."""
    d2 = squared_distances(x, c)
    close = np.flatnonzero(d2 >= d2.max() * (1.0 - 1e-10))  # only these can be equal after rounding
    rounded = comparable(d2[close])
    best = close[rounded == rounded.max()]
    return int(best[np.argmin(ids[best])])


def mixed(ids: np.ndarray) -> np.ndarray:
    """Ids with their bits mixed, one to one."""
    h = ids.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mark(ids: np.ndarray) -> int:
    """Order-free fingerprint of a set of ids (xor of mixed bits)."""
    h = mixed(ids)
    return int(np.bitwise_xor.reduce(h).astype(np.int64)) if h.size else 0


def signed(rows: np.ndarray) -> np.ndarray:
    """Make the entry of largest magnitude of each row positive (first one wins a tie)."""
    if rows.size == 0:
        return rows
    lead = rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)]
    return rows * np.where(lead < 0, -1.0, 1.0)[:, None]


def top_components(values: np.ndarray, rows: np.ndarray, d: int, tol: float):
    """First ``d`` singular values above the relative cut, with their signed vectors."""
    order = np.argsort(-values, kind="stable")[:d]
    values, rows = values[order], rows[order]
    keep = (values > tol * values[0]) & (values > 0) if values.size else np.zeros(0, bool)
    return values[keep], signed(rows[keep])


def plane_of_scatter(scatter: np.ndarray, d: int, tol: float = SCATTER_TOL):
    w, v = np.linalg.eigh(scatter)
    return top_components(np.sqrt(np.maximum(w, 0.0)), v.T, d, tol)


def plane_of_rows(centered: np.ndarray, d: int, tol: float = SCATTER_TOL):
    n, dims = centered.shape
    if n > 2 * dims:
        return plane_of_scatter(centered.T @ centered, d, tol)
    _, s, vt = np.linalg.svd(centered, full_matrices=False)
    return top_components(s, vt, d, tol)


def plane_of_factor(r: np.ndarray, d: int, tol: float = DIRECT_TOL):
    """The same from any factor ``r`` with the rows' inner products."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return top_components(s, vt, d, tol)


def basis_cosine(a: np.ndarray, b: np.ndarray) -> float | None:
    """Signed cosine of two bases; None when either is empty."""
    if len(a) == 0 or len(b) == 0:
        return None
    k = min(len(a), len(b))
    return float(np.sum(a[:k] * b[:k]) / np.sqrt(np.sum(a * a) * np.sum(b * b)))


def pack(sym: np.ndarray) -> np.ndarray:
    return sym[np.triu_indices(sym.shape[0])]


def unpack(packed: np.ndarray) -> np.ndarray:
    n = int((np.sqrt(8 * packed.size + 1) - 1) / 2)
    out = np.zeros((n, n))
    out[np.triu_indices(n)] = packed
    return out + np.triu(out, 1).T
