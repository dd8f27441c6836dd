"""Distances and ranks of subspaces, on small matrices."""

from __future__ import annotations

import numpy as np


def effective_rank(matrix: np.ndarray) -> float:
    """exp of the entropy of the positive eigenvalues' shares."""
    e = np.linalg.eigvalsh((matrix + matrix.T) / 2)
    e = e[e > 0]
    if not len(e):
        return 0.0
    p = e / e.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def factor_covariance(factors: np.ndarray) -> tuple[np.ndarray, float, float]:
    """FF'/T, its effective rank over eigenvalues above eps * k * largest, and the gap smallest / largest."""
    k, t = factors.shape
    cov = factors @ factors.T / t
    e = np.linalg.eigvalsh(cov)[::-1]
    top = e[e > np.finfo(float).eps * k * max(e[0], 0)]
    p = top / top.sum() if len(top) else top
    rank = float(np.exp(-(p * np.log(p)).sum())) if len(top) else 0.0
    return cov, rank, float(e[-1] / e[0]) if e[0] > 0 else float("nan")


def orthonormal(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a)[0]


def principal_angles(a: np.ndarray, b: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Angles between column spaces (of basis @ a and basis @ b, if a basis is given), largest first."""
    if basis is not None:
        a, b = basis @ a, basis @ b
    s = np.linalg.svd(orthonormal(a).T @ orthonormal(b), compute_uv=False)
    return np.arccos(np.clip(s, -1, 1))[::-1]


#: Distances as norms of the principal angles.
METRICS = {
    "geodesic": lambda angles: np.linalg.norm(angles),
    "chordal": lambda angles: np.linalg.norm(np.sin(angles)),
    "projection": lambda angles: np.sqrt(2.0) * np.linalg.norm(np.sin(angles)),
}


def distance(a: np.ndarray, b: np.ndarray, metric: str = "geodesic", basis: np.ndarray | None = None) -> float:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    return float(METRICS[metric](principal_angles(a, b, basis)))


def random_baseline(ambient: int, k: int) -> float:
    """Typical projection distance of two random subspaces; NaN where a subspace fills the space or is none."""
    if not 0 < k < ambient:
        return float("nan")
    return float(np.sqrt(2 * k * (ambient - k) / (ambient + 1)))
