"""Numeric kernels over batches of spectra (rows), in numpy only."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def polynomial_weights(window: int, order: int, deriv: int, offset: int) -> tuple[float, ...]:
    """Weights whose dot product with a window is the fitted polynomial's derivative at ``offset`` from its centre."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    at = np.zeros(order + 1)
    for k in range(deriv, order + 1):
        at[k] = np.prod(np.arange(k - deriv + 1, k + 1, dtype=float)) * float(offset) ** (k - deriv)
    return tuple(at @ np.linalg.pinv(design))


def check_window(window: int, order: int, p: int) -> None:
    if window % 2 == 0 or window < 1 or window > p or order >= window:
        raise ValueError(f"a window must be odd, above the order and at most {p}, got {window} with order {order}")


def smoothing_matrix(p: int, window: int, order: int, deriv: int = 0) -> np.ndarray:
    """(p, p): row j has the weights of output j; edges evaluate the end windows' polynomials."""
    check_window(window, order, p)
    half = window // 2
    out = np.zeros((p, p))
    for j in range(p):
        centre = min(max(j, half), p - 1 - half)
        out[j, centre - half : centre + half + 1] = polynomial_weights(window, order, deriv, j - centre)
    return out


def default_window(p: int) -> int:
    window = min(17, p // 2)
    return window if window % 2 else window - 1


def difference(p: int, d: int) -> np.ndarray:
    return np.diff(np.eye(p), n=d, axis=0)


@lru_cache(maxsize=16)
def penalty_band(p: int, lam: float, d: int) -> np.ndarray:
    """Lower band of lam * D'D, (d + 1, p)."""
    if lam <= 0 or d < 1:
        raise ValueError("lam must be positive and d at least 1")
    full = difference(p, d)
    full = lam * full.T @ full
    return np.stack([np.concatenate([np.diagonal(full, -k), np.zeros(k)]) for k in range(d + 1)])


def band_solve(diagonal: np.ndarray, band: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves (diag(w) + band) z = rhs for every row at once by a banded L D L'.

    ``diagonal`` and ``rhs`` are (rows, p), ``band`` is the shared lower band.
    """
    rows, p = rhs.shape
    d = len(band) - 1
    low = np.zeros((d + 1, p, rows))
    for j in range(p):
        for k in range(min(d, p - 1 - j) + 1):
            v = np.full(rows, band[k, j]) + (diagonal[:, j] if k == 0 else 0)
            for m in range(max(0, j + k - d), j):
                v = v - low[j + k - m, m] * low[j - m, m] * low[0, m]
            low[k, j] = v if k == 0 else v / low[0, j]
    z = rhs.T.astype(float).copy()
    for j in range(p):
        for k in range(1, min(d, j) + 1):
            z[j] -= low[k, j - k] * z[j - k]
    z /= low[0]
    for j in range(p - 1, -1, -1):
        for k in range(1, min(d, p - 1 - j) + 1):
            z[j] -= low[k, j] * z[j + k]
    return z.T


def whittaker(x: np.ndarray, lam: float = 1e4, d: int = 2) -> np.ndarray:
    return band_solve(np.ones_like(x), penalty_band(x.shape[1], lam, d), x)


def asymmetric_baseline(x: np.ndarray, lam: float = 1e6, d: int = 2, p: float = 1e-3, rounds: int = 10) -> np.ndarray:
    """Baselines by asymmetric least squares."""
    band, w, z = penalty_band(x.shape[1], lam, d), np.ones_like(x), x
    for _ in range(rounds):
        z = band_solve(w, band, w * x)
        w = np.where(x > z, p, 1 - p)
    return z


# The low-pass decomposition filter of the fourth symlet.
SYM4 = np.array([-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427])


@lru_cache(maxsize=32)
def wavelet_filter(name: str) -> tuple[float, ...]:
    """The low-pass decomposition filter: haar, db1 to db12, sym2 to sym4.

    A Daubechies filter with n vanishing moments is the spectral factor of its
    half-band polynomial whose roots lie inside the unit circle; the first three
    symlets are the same filters.
    """
    if name == "sym4":
        return tuple(SYM4)
    found = re.fullmatch(r"(haar|db|sym)(\d*)", name)
    n = 1 if name == "haar" else int(found[2] or 0) if found and found[1] != "haar" else 0
    if not 1 <= n <= (3 if name.startswith("sym") else 12) or name == "sym1":
        raise ValueError(f"no wavelet {name!r}; known: haar, db1 to db12, sym2 to sym4")
    taps = np.array([1.0])
    for y in np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]):
        pair = np.roots([1, 4 * y - 2, 1])  # y = (2 - z - 1/z) / 4
        taps = np.convolve(taps, [1, -pair[np.argmin(np.abs(pair))]])
    for _ in range(n):
        taps = np.convolve(taps, [1, 1])
    taps = np.real(taps)
    return tuple(taps[::-1] * math.sqrt(2) / taps.sum())


def _bank(low: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The synthesis filters, low and high, of a decomposition filter."""
    low_d = np.array(low)
    return low_d[::-1], low_d * (-1.0) ** np.arange(len(low_d))


def _extended(x: np.ndarray, by: int) -> np.ndarray:
    """Straight continuation from the two samples at either end."""
    left = x[:, :1] + np.arange(by, 0, -1) * (x[:, :1] - x[:, 1:2])
    right = x[:, -1:] + np.arange(1, by + 1) * (x[:, -1:] - x[:, -2:-1])
    return np.concatenate([left, x, right], axis=1)


def dwt(x: np.ndarray, low: tuple[float, ...] = tuple(SYM4)) -> tuple[np.ndarray, np.ndarray]:
    """One level: floor((n + taps - 1) / 2) approximation and detail coefficients per row."""
    n, f = x.shape[1], len(low)
    wide = _extended(x, f - 1)
    view = np.lib.stride_tricks.sliding_window_view(wide, f, axis=1)[:, 1 : n + f - 1 : 2]
    low_r, high_r = _bank(low)
    return view @ low_r, view @ high_r


def idwt(a: np.ndarray, d: np.ndarray, low: tuple[float, ...] = tuple(SYM4)) -> np.ndarray:
    """The inverse of a level: 2 * coefficients - taps + 2 samples."""
    m, f = a.shape[1], len(low)
    low_r, high_r = _bank(low)
    up = np.zeros((2, a.shape[0], 2 * m + 2 * f))
    up[0, :, f : f + 2 * m : 2], up[1, :, f : f + 2 * m : 2] = a, d
    view = np.lib.stride_tricks.sliding_window_view(up, f, axis=2)
    full = view[0] @ low_r[::-1] + view[1] @ high_r[::-1]
    return full[:, f - 1 : 2 * m + 1]


def wavelet_denoise(x: np.ndarray, level: int = 2, full: bool = False, wavelet: str = "sym4") -> np.ndarray:
    """Soft-thresholded details at sigma sqrt(2 ln n), sigma from the finest ones.

    The rows keep their length, unless ``full`` asks for all that the inverse gives.
    """
    n, details, a, low = x.shape[1], [], np.asarray(x, float), wavelet_filter(wavelet)
    for _ in range(level):
        a, d = dwt(a, low)
        details.append(d)
    sigma = np.median(np.abs(details[0]), axis=1) / 0.6745
    limit = (sigma * np.sqrt(2 * np.log(n)))[:, None]
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
        a = idwt(a[:, : d.shape[1]], d, low)
    if full:
        return a
    return a[:, :n] if a.shape[1] >= n else np.pad(a, ((0, 0), (0, n - a.shape[1])), mode="edge")


def wiener(x: np.ndarray, window: int = 3) -> np.ndarray:
    """Local Wiener filter with zeros beyond the ends; the noise is the mean local variance."""
    half = window // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (half, half))), window, axis=1)
    m = view.mean(axis=2)
    v = (view**2).mean(axis=2) - m**2
    noise = v.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(v > 0, 1 - noise / v, 0)
    return np.where(v < noise, m, m + gain * (x - m))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 100) -> np.ndarray:
    """min |a z - b| with z >= 0 for few unknowns: Lawson-Hanson on the normal equations."""
    return nnls_gram(a.T @ a, a.T @ b, rounds)


def nnls_gram(g: np.ndarray, c: np.ndarray, rounds: int = 100) -> np.ndarray:
    k = len(c)
    z, passive = np.zeros(k), np.zeros(k, bool)
    tol = 1e-12 * max(1.0, float(np.abs(c).max(initial=0)))
    for _ in range(rounds * k):
        slope = c - g @ z
        if passive.all() or slope[~passive].max(initial=-np.inf) <= tol:
            break
        passive[np.flatnonzero(~passive)[np.argmax(slope[~passive])]] = True
        while True:
            s = np.zeros(k)
            on = np.flatnonzero(passive)
            s[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on], rcond=None)[0]
            if s[on].min(initial=1) > 0:
                z = s
                break
            down = on[s[on] <= 0]
            step = np.min(z[down] / np.maximum(z[down] - s[down], 1e-300))
            z = z + step * (s - z)
            passive &= z > 1e-15
            z[~passive] = 0
            if not passive.any():
                break
    return z
