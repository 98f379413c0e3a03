"""Small symmetric systems, many at a time: Cholesky factors and what refuses them."""

from __future__ import annotations

import numpy as np

#: fixed values: how far from symmetric, and how small a pivot, against the largest diagonal entry (1 at least)
ASYMMETRY, PIVOT = 1e-9, 1e-12


def cholesky(a: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors of a stack of matrices (rows of ``a``), and whether each is symmetric and positive definite; the factor of
    one that is not means nothing. ``scale``: what pivots are small against, if not the matrix's own diagonal."""
    a = np.asarray(a, dtype=float)
    own = np.maximum(np.abs(np.diagonal(a, axis1=-2, axis2=-1)).max(axis=-1, initial=0), 1.0)
    scale = own if scale is None else scale
    good = (np.abs(a - np.swapaxes(a, -1, -2)) <= ASYMMETRY * own[:, None, None]).all(axis=(-1, -2))
    out = np.zeros_like(a)
    for j in range(a.shape[-1]):
        left = a[:, j:, j] - np.einsum("nik,nk->ni", out[:, j:, :j], out[:, j, :j])
        pivot = left[:, 0]
        good &= pivot > PIVOT * scale
        out[:, j:, j] = left / np.sqrt(np.where(pivot > 0, pivot, 1.0))[:, None]
    return out, good


def solve_spd(a: np.ndarray, b: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x with a x = b for each matrix and row of ``b``, and whether it may be taken."""
    factor, good = cholesky(a, scale)
    safe = np.where(good[:, None, None], factor, np.eye(factor.shape[-1]))
    half = np.linalg.solve(safe, np.asarray(b, dtype=float)[:, :, None])
    return np.linalg.solve(np.swapaxes(safe, -1, -2), half)[:, :, 0], good
