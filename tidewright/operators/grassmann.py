"""Factor loadings on the Grassmann manifold: min 1/T sum ||r - Z W b_t||^2, b_t ridge on Z W, from month moments."""

from __future__ import annotations

import numpy as np

from tidewright.operators.ipca import Model
from tidewright.operators.moments import Moments


def factors(w: np.ndarray, m: Moments, shrink: float) -> np.ndarray:
    """Ridge factors of every month given W, K x T."""
    inner = np.einsum("lk,tlm,mj->tkj", w, m.A, w) + shrink * np.eye(w.shape[1])
    return np.linalg.solve(inner, np.einsum("lk,tl->tk", w, m.b)[..., None])[..., 0].T


def loss_and_gradient(w: np.ndarray, m: Moments, shrink: float) -> tuple[float, np.ndarray]:
    """The profiled loss and its Euclidean gradient. The penalty isn't in the loss, so b_t's own change counts too."""
    t, k = len(m.n), w.shape[1]
    aw = m.A @ w
    inner = np.einsum("lk,tlj->tkj", w, aw)
    c = np.einsum("lk,tl->tk", w, m.b)
    full = inner + shrink * np.eye(k)
    beta = np.linalg.solve(full, c[..., None])[..., 0]
    mb = np.einsum("tkj,tj->tk", inner, beta)
    loss = (m.yy - 2 * (beta * c).sum(axis=1) + (beta * mb).sum(axis=1)).sum() / t
    v = np.linalg.solve(full, (2 * mb - 2 * c)[..., None])[..., 0]
    grad = np.einsum("tl,tk->lk", m.b, v - 2 * beta) + np.einsum("tlj,tj,tk->lk", aw, 2 * beta - v, beta) - np.einsum("tlj,tj,tk->lk", aw, beta, v)
    return float(loss), grad / t


def retract(w: np.ndarray, step: np.ndarray, method: str = "svd") -> np.ndarray:
    if method == "svd":
        u, _, v = np.linalg.svd(w + step, full_matrices=False)
        return u @ v
    q, r = np.linalg.qr(w + step)
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def trust_regions(w: np.ndarray, m: Moments, shrink: float, max_iter: int, tol: float, retraction: str, inner: int = 30) -> tuple[np.ndarray, int]:
    """(loadings, iterations): each step minimises a quadratic model within a radius by truncated conjugate gradients; the
    Hessian along a direction is a central difference of gradients, carried back to the tangent space."""
    flat = lambda w, x: x - w @ (w.T @ x)
    gradient = lambda w: flat(w, loss_and_gradient(w, m, shrink)[1])
    widest = np.pi / 2 * np.sqrt(w.shape[1])
    radius, loss, turn = widest / 8, loss_and_gradient(w, m, shrink)[0], 0
    while turn < max_iter and np.linalg.norm(g := gradient(w)) > tol:

        def curve(x: np.ndarray, w=w) -> np.ndarray:
            h = 1e-5 / max(np.linalg.norm(x), 1e-300)
            return flat(w, gradient(retract(w, h * x, retraction)) - gradient(retract(w, -h * x, retraction))) / (2 * h)

        s, r, d, hs = np.zeros_like(w), g, -g, np.zeros_like(w)
        for _ in range(inner):
            hd = curve(d)
            bend, size = float((d * hd).sum()), float((r * r).sum())
            a = size / bend if bend > 0 else np.inf
            if not np.isfinite(a) or np.linalg.norm(s + a * d) >= radius:  # on to the edge
                dd, sd, ss = float((d * d).sum()), float((s * d).sum()), float((s * s).sum())
                a = (-sd + np.sqrt(max(sd * sd + dd * (radius * radius - ss), 0.0))) / dd
                s, hs = s + a * d, hs + a * hd
                break
            s, hs, r = s + a * d, hs + a * hd, r + a * hd
            if (left := float((r * r).sum())) <= size * 1e-2 or left <= tol * tol:
                break
            d = -r + left / size * d
        new = retract(w, s, retraction)
        new_loss = loss_and_gradient(new, m, shrink)[0]
        said = -float((g * s).sum() + 0.5 * (s * hs).sum())
        kept = (loss - new_loss) / said if said > 0 else -1.0
        if kept < 0.25:
            radius /= 4
        elif kept > 0.75 and np.linalg.norm(s) >= 0.99 * radius:
            radius = min(2 * radius, widest)
        if kept > 0.1:
            w, loss = new, new_loss
        elif radius < 1e-12:
            break
        turn += 1
    return w, turn


def fit(m: Moments, k: int, shrink: float = 1e-8, max_iter: int = 200, tol: float = 1e-6, retraction: str = "svd", optimizer: str = "cg", beta_rule: str = "PolakRibiere", warm: np.ndarray | None = None, seed: int = 0) -> Model:
    """Riemannian conjugate gradient (or steepest descent) with backtracking, or trust regions, from a warm or a seeded random start."""
    size = m.b.shape[1]
    if not 0 < k <= size:
        raise ValueError("0 < k <= characteristics")
    if optimizer not in ("cg", "sd", "tr") or retraction not in ("svd", "qr"):
        raise ValueError("optimizer cg, sd or tr, retraction svd or qr")
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, k)) if warm is None else warm)[0]
    if optimizer == "tr":
        w, turn = trust_regions(w, m, shrink, max_iter, tol, retraction)
        return Model(w, factors(w, m, shrink), list(m.months), turn, k, m)
    loss, g = loss_and_gradient(w, m, shrink)
    g = g - w @ (w.T @ g)
    d, step, turn = -g, 1.0 / max(np.linalg.norm(g), 1e-12), 0
    while turn < max_iter and np.linalg.norm(g) > tol:
        if (slope := float((g * d).sum())) >= 0:
            d, slope = -g, -float((g * g).sum())
        step *= 2
        while True:
            new = retract(w, step * d, retraction)
            new_loss, raw = loss_and_gradient(new, m, shrink)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-16:
                break
            step /= 2
        if step < 1e-16:
            break
        ng = raw - new @ (new.T @ raw)
        moved_g, moved_d = g - new @ (new.T @ g), d - new @ (new.T @ d)
        top = float((ng * (ng - moved_g)).sum()) if beta_rule == "PolakRibiere" else float((ng * ng).sum())
        d = -ng + (max(0.0, top / max(float((g * g).sum()), 1e-300)) * moved_d if optimizer == "cg" else 0)
        w, loss, g, turn = new, new_loss, ng, turn + 1
    return Model(w, factors(w, m, shrink), list(m.months), turn, k, m)


def evolve(m: Moments, k: int, generations: int = 50, members: int = 20, seed: int = 0) -> Model:
    """The derivative-free variant: differential evolution over orthonormalised matrices, then a polish by gradient."""
    rng, size = np.random.default_rng(seed), m.b.shape[1]
    project = lambda x: np.linalg.qr(x.reshape(size, k))[0]
    crowd = rng.uniform(-1, 1, (members, size * k))
    value = np.array([loss_and_gradient(project(x), m, 0.0 + 1e-12)[0] for x in crowd])
    for _ in range(generations):
        for i in range(members):
            a, b = crowd[rng.choice(members, 2, replace=False)]
            trial = np.where(rng.random(size * k) < 0.7, crowd[value.argmin()] + rng.uniform(0.5, 1) * (a - b), crowd[i])
            if (v := loss_and_gradient(project(trial), m, 1e-12)[0]) < value[i]:
                crowd[i], value[i] = trial, v
    return fit(m, k, 1e-12, warm=project(crowd[value.argmin()]))
