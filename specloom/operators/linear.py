"""Linear calibration models solved from sufficient statistics.

Each solver maps centred cross products to coefficients, so a model costs one
Gram however many components, subsets or folds are tried on it.
"""

from __future__ import annotations

import numpy as np

from .gram import Centred


def ols(c: Centred) -> np.ndarray:
    """Least squares, minimum norm where columns are dependent."""
    return np.linalg.pinv(c.xx, rcond=1e-12, hermitian=True) @ c.xy


def ridge(c: Centred, alpha: float = 1.0) -> np.ndarray:
    return np.linalg.solve(c.xx + alpha * np.eye(len(c.xy)), c.xy)


def elasticnet(c: Centred, alpha: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent on (1/2n)|y - xb|^2 + alpha (l1 |b| + (1 - l1)/2 |b|^2)."""
    g, q, n = c.xx / c.n, c.xy / c.n, len(c.xy)
    b, fit = np.zeros(n), np.zeros(n)
    for _ in range(max_iter):
        moved = 0.0
        for j in range(n):
            r = q[j] - fit[j] + g[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0) / max(g[j, j] + alpha * (1 - l1_ratio), 1e-300)
            if new != b[j]:
                fit += g[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tol * max(1e-12, np.abs(b).max()):
            break
    return b


def lasso(c: Centred, alpha: float = 1.0, **k) -> np.ndarray:
    return elasticnet(c, alpha, 1.0, **k)


def omp(c: Centred, n_nonzero: int | None = None) -> np.ndarray:
    """Greedy selection by normed correlation with the residual; a tenth of the channels by default."""
    p = len(c.xy)
    k = n_nonzero or max(1, int(0.1 * p))
    b, on = np.zeros(p), []
    scale = np.sqrt(np.maximum(np.diag(c.xx), 1e-300))
    for _ in range(min(k, p)):
        score = np.abs(c.xy - c.xx @ b) / scale
        score[on] = -1
        on.append(int(np.argmax(score)))
        b = np.zeros(p)
        b[on] = np.linalg.lstsq(c.xx[np.ix_(on, on)], c.xy[on], rcond=None)[0]
    return b


def lars(c: Centred, max_steps: int = 500) -> np.ndarray:
    """Least angle regression to the end of its path."""
    p = len(c.xy)
    scale = np.sqrt(np.maximum(np.diag(c.xx), 1e-300))
    g, q = c.xx / np.outer(scale, scale), c.xy / scale
    b, on = np.zeros(p), []
    for _ in range(min(max_steps, p, int(c.n) - 1)):
        r = q - g @ b
        off = [j for j in range(p) if j not in on]
        if np.abs(r[off]).max(initial=0) < 1e-10:
            break
        on.append(off[int(np.argmax(np.abs(r[off])))])
        top, sign = np.abs(r[on]).max(), np.sign(r[on])
        step = np.linalg.lstsq(g[np.ix_(on, on)], sign, rcond=None)[0]
        direction = np.zeros(p)
        direction[on] = step
        slope, size = g @ direction, top
        for j in off:
            if j in on:
                continue
            for s in (1, -1):
                at = (top - s * r[j]) / max(1 - s * slope[j], 1e-12)
                if 1e-12 < at < size:
                    size = at
        b = b + size * direction
    return b / scale


def pls_path(c: Centred, n_components: int, scale: bool = True) -> np.ndarray:
    """(n_components, p): coefficients after each PLS1 component, columns scaled by their sample sd.

    A direction is made conjugate to all earlier ones twice over, and its step is taken against what is left to
    explain, computed anew: components past the point of convergence then move the coefficients by rounding only.
    """
    sd = np.sqrt(np.maximum(np.diag(c.xx), 0) / max(c.n - 1, 1)) if scale else np.ones(len(c.xy))
    sd = np.where(sd > 0, sd, 1.0)
    g, q = c.xx / np.outer(sd, sd), c.xy / sd
    b, out, floor = np.zeros(len(q)), [], 1e-14 * np.linalg.norm(q)
    rs, ps = np.zeros((0, len(q))), np.zeros((0, len(q)))
    for _ in range(n_components):
        residual = q - g @ b
        size = np.linalg.norm(residual)
        if size > floor:
            r = residual / size
            for _ in range(2):
                r = r - (ps @ r) @ rs
            t = float(r @ g @ r)
            # Rows are independent only as far as rounding goes: a direction that is all rounding explains nothing.
            if t > 1e-14 * np.trace(g) * float(r @ r) and np.linalg.norm(r) > 1e-12:
                b = b + r * (float(r @ residual) / t)
                rs, ps = np.vstack([rs, r]), np.vstack([ps, g @ r / t])
        out.append(b / sd)
    return np.array(out)


def pls(c: Centred, n_components: int = 2, scale: bool = True) -> np.ndarray:
    return pls_path(c, n_components, scale)[-1]


def pcr(c: Centred, n_components: int = 5) -> np.ndarray:
    """Regression on the leading principal components."""
    values, vectors = np.linalg.eigh(c.xx)
    v = vectors[:, ::-1][:, :n_components]
    return v @ ((v.T @ c.xy) / np.maximum(values[::-1][:n_components], 1e-300))


SOLVERS = {"ols": ols, "ridge": ridge, "lasso": lasso, "elasticnet": elasticnet, "omp": omp, "lars": lars, "pls": pls, "pcr": pcr}
LATENT = ("pls", "pcr")
