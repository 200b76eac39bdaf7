"""Figures of merit of a calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, literal, moments


def sensitivity(coef: np.ndarray) -> float:
    size = float(np.linalg.norm(coef))
    return 1 / size if size > 0 else math.inf


def analytical_sensitivity(coef: np.ndarray, noise: float) -> float:
    return sensitivity(coef) / noise if noise > 0 else math.inf


def selectivity(coef: np.ndarray, target: np.ndarray) -> float:
    size = float(np.linalg.norm(coef))
    return float(np.linalg.norm(np.asarray(coef) * target)) / size if size > 0 else math.nan


def spectral_noise(blanks: DataFrame) -> float:
    """Root mean square of all cells around their spectrum's mean."""
    s, n = blanks.agg(F.sum(moments(F.col("x"))["m2"]), F.sum(F.size("x"))).first()
    return math.sqrt(s / n)


def regression_vector(predict, x0: np.ndarray, coef: np.ndarray | None = None, eps: float = 1e-4) -> np.ndarray:
    """The model's own coefficients, or forward differences at one spectrum in a single call."""
    if coef is not None and len(coef) == len(x0):
        return np.asarray(coef, float)
    rows = np.vstack([x0, x0 + eps * np.eye(len(x0))])
    y = np.asarray(predict(rows), float)
    return (y[1:] - y[0]) / eps


def figures_of_merit(coef: np.ndarray, intercept: float, blanks: DataFrame, target: np.ndarray | None = None) -> dict:
    pred = dot(F.col("x"), literal(coef)) + float(intercept)
    n, s1, s0 = blanks.agg(F.count("*"), F.stddev_samp(pred), F.stddev_pop(pred)).first()
    spread = s1 if n > 1 else s0
    sen, noise = sensitivity(coef), spectral_noise(blanks)
    return {
        "sen": sen,
        "gamma": analytical_sensitivity(coef, noise),
        "s_x": noise,
        "s_0": spread,
        "lod": 3.3 * spread / sen if 0 < sen < math.inf else math.inf,
        "loq": 10 * spread / sen if 0 < sen < math.inf else math.inf,
        "sel": selectivity(coef, target) if target is not None else math.nan,
    }
