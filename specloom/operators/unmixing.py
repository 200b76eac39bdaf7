"""Mixture resolution: X = C S with non-negative concentrations and spectra.

The concentration step is row-parallel (S is broadcast, k spectra long); the
spectra step needs only C'C and C'X, summed like a Gram. The mixture itself
never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.storage import durable
from .gram import column_stats, gram
from .sequences import unimodal


def _rows_nnls(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    g = s @ s.T
    free = np.linalg.lstsq(g, s @ x.T, rcond=None)[0].T
    bad = np.flatnonzero((free < 0).any(axis=1))
    for i in bad:
        free[i] = kernels.nnls_gram(g, s @ x[i])
    return free


def simplisma(df: DataFrame, k: int, offset: float = 0.05) -> np.ndarray:
    """Purest channels by purity times the share that the ones taken leave unexplained; spectra by least squares.

    Negative values of the spectra are cut only where the data have none.
    """
    g = gram(df.select("x"), y=None).m[1:-1, 1:-1]
    mean, sd = column_stats(df)
    alpha = offset * np.abs(mean).max()
    purity, chosen = sd / np.maximum(np.abs(mean) + alpha, 1e-12), []
    s, share = np.zeros((0, len(mean))), np.ones(len(mean))
    for _ in range(k):
        score = purity * share
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        # C = X[:, chosen]: all least squares on it, (C'C)^-1 C'X, and their residuals are in the Gram.
        s = np.linalg.lstsq(g[np.ix_(chosen, chosen)], g[chosen], rcond=None)[0]
        left = np.diag(g) - (g[chosen] * s).sum(0)
        share = np.sqrt(np.maximum(left, 0) / np.maximum(np.diag(g), 1e-300))
    return normalised(np.maximum(s, 0) if _lowest(df) >= -1e-12 else s)


def _lowest(df: DataFrame) -> float:
    return df.agg(F.min(F.array_min("x"))).first()[0]


def orthogonal_projection(df: DataFrame, k: int) -> np.ndarray:
    """The spectrum of largest norm, then those least explained by the ones taken; negative values count as zero."""
    clipped = df.select(F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x"))
    chosen: list[np.ndarray] = []
    for _ in range(k):
        basis = np.linalg.qr(np.array(chosen).T)[0] if chosen else None

        def residual(batches: Iterator[pd.DataFrame], basis=basis) -> Iterator[pd.DataFrame]:
            best = None
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b["x"].to_numpy())
                r = x - (x @ basis) @ basis.T if basis is not None else x
                i = int((r * r).sum(1).argmax())
                if best is None or (r[i] @ r[i]) > best[0]:
                    best = (float(r[i] @ r[i]), x[i].tolist())
            if best:
                yield pd.DataFrame({"d": [best[0]], "x": [best[1]]})

        row = clipped.mapInPandas(residual, "d double, x array<double>").agg(F.max_by("x", F.struct("d", "x"))).first()
        chosen.append(np.array(row[0]))
    return np.array(chosen)


def normalised(s: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(s, axis=1, keepdims=True)
    return s / np.where(size > 0, size, 1)


def project(df: DataFrame, s: np.ndarray, non_negative: bool = True, closure: bool = False) -> DataFrame:
    """``df`` with the concentrations ``c`` of the components ``s``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b]) if len(b) else np.zeros((0, s.shape[1]))
            c = _rows_nnls(x, s) if non_negative else np.linalg.lstsq(s.T, x.T, rcond=None)[0].T
            if closure:
                total = c.sum(axis=1, keepdims=True)
                c = c / np.where(np.abs(total) > 1e-300, total, 1)
            yield pd.Series(list(c))

    return df.withColumn("c", F.pandas_udf(run, "array<double>")(F.col("x")))


def single_peaks(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, x, c) with every concentration rising up to its first maximum and falling after it, in the order of ``key``.

    A component is one series, so a task holds one number of each row.
    """
    long = df.select(key, F.posexplode("c").alias("j", "v"))
    back = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda q: q["v"])
    c = unimodal(long, "j", key, "v").groupBy(key).agg(back.alias("c"))
    return df.drop("c").join(c, key)


def reconstruct(df: DataFrame, s: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(np.stack(b.to_numpy()) @ s)) if len(b) else b

    return df.withColumn("rebuilt", F.pandas_udf(run, "array<double>")(F.col("c")))


@dataclass
class Resolved:
    spectra: np.ndarray
    error: float
    rounds: int


def mcr_als(df: DataFrame, n_components: int = 3, max_iter: int = 200, tol: float = 1e-7, non_negative: bool = True, closure: bool = False, start: np.ndarray | None = None, seed: int = 0, unimodality: bool = False, key: str = "sample_id") -> Resolved:
    """Alternating least squares from purest channels, or from random spectra where X has negatives.

    The spectra are written once and read by each round, which sums C'C and C'X
    in one pass. ``unimodality`` lets each concentration rise and fall once in
    the order of ``key``. The rounds end when the residual of concentrations and
    normalised spectra stays the same.
    """
    df = durable(df.select(key, "x") if unimodality else df.select("x"))
    if start is None:
        p = df.select(F.size("x")).first()[0]
        start = simplisma(df, n_components) if _lowest(df) >= -1e-12 else normalised(np.random.default_rng(seed).uniform(size=(n_components, p)))
    s, before, error = start, np.inf, np.inf
    for i in range(1, max_iter + 1):
        found = project(df, s, non_negative, closure)
        if unimodality:
            found = single_peaks(found, key)
        sums = gram(found.select(F.concat("c", "x").alias("x")), y=None).m[1:-1, 1:-1]
        k = n_components
        cc, cx, xx = sums[:k, :k], sums[:k, k:], float(np.trace(sums[k:, k:]))
        new = np.stack([kernels.nnls_gram(cc, cx[:, j]) for j in range(cx.shape[1])], axis=1) if non_negative else np.linalg.lstsq(cc, cx, rcond=None)[0]
        s = normalised(new)
        error = max(xx - 2 * float((s * cx).sum()) + float((s * (cc @ s)).sum()), 0) ** 0.5
        if abs(before - error) < tol * max(1.0, before if np.isfinite(before) else 1.0):
            break
        before = error
    return Resolved(s, error, i)


def ambiguity(df: DataFrame, fitted: Resolved, n_trials: int = 20, seed: int = 0, max_iter: int = 50, **options) -> float:
    """Mean cosine distance of each spectrum to its nearest one in refits from random spectra."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n_trials):
        start = normalised(rng.uniform(size=fitted.spectra.shape))
        other = mcr_als(df, len(fitted.spectra), max_iter=max_iter, start=start, **options).spectra
        out.append(1 - np.abs(normalised(fitted.spectra) @ normalised(other).T).max(axis=1))
    return float(np.clip(np.mean(out), 0, 1))


def feasible_bands(df: DataFrame, n_points: int = 360, tol: float = 1e-9) -> dict:
    """Rank-two self modelling: rotation angles with non-negative spectra and concentrations, as runs."""
    g = gram(df.select("x"), y=None).m[1:-1, 1:-1]
    values, vectors = np.linalg.eigh(g)
    v = vectors[:, ::-1][:, :2].T
    if v[0].sum() < 0:
        v[0] = -v[0]
    angles = np.linspace(-np.pi / 2, np.pi / 2, n_points)
    spectra_ok = np.array([(np.cos(a) * v[0] + np.sin(a) * v[1]).min() >= -tol for a in angles])
    t = F.struct(*[F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, b))), lambda p, q: p * q), F.lit(0.0), lambda a, z: a + z).alias(f"t{k}") for k, b in enumerate(v)])
    lows = df.select(t.alias("t")).agg(*[F.min(F.col("t.t0") * float(np.cos(a)) + F.col("t.t1") * float(np.sin(a))) for a in angles]).first()
    conc_ok = np.array([x >= -tol for x in lows])
    runs = lambda ok: [(float(angles[r[0]]), float(angles[r[-1]])) for r in np.split(np.flatnonzero(ok), np.flatnonzero(np.diff(np.flatnonzero(ok)) > 1) + 1) if len(r)]
    return {"spectra": runs(spectra_ok), "concentrations": runs(conc_ok), "singular_values": np.sqrt(np.maximum(values[::-1][:2], 0)).tolist()}
