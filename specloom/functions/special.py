"""Distribution functions by incomplete beta and gamma functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_TINY, _EPS = 1e-300, 1e-15


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), _TINY, key=abs)
    value = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + k * d, _TINY, key=abs)
            c = max(1 + k / c, _TINY, key=abs)
            value *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * value


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a + 1, fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = value = 1 / a
        n = a
        while abs(term) > abs(value) * _EPS:
            n += 1
            term *= x / n
            value += term
        return value * front
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    value = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / max(k * d + b, _TINY, key=abs)
        c = max(b + k / c, _TINY, key=abs)
        value *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return 1 - front * value


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d1 * x + d2)) if x > 0 else 1.0


def chi2_cdf(x: float, k: float) -> float:
    return gamma_inc(k / 2, x / 2)


def chi2_sf(x: float, k: float) -> float:
    return 1 - chi2_cdf(x, k)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def quantile(cdf: Callable[[float], float], p: float, low: float = 0.0, high: float = 1.0) -> float:
    """The point where an increasing cdf reaches p; ``high`` doubles until it brackets."""
    while cdf(high) < p and high < 1e300:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def f_ppf(p: float, d1: float, d2: float) -> float:
    return quantile(lambda x: f_cdf(x, d1, d2), p)


def chi2_ppf(p: float, k: float) -> float:
    return quantile(lambda x: chi2_cdf(x, k), p)


def t_ppf(p: float, df: float) -> float:
    return -t_ppf(1 - p, df) if p < 0.5 else quantile(lambda x: t_cdf(x, df), p)
