"""Instrument transfer: slave spectra made to look like the master's.

Pairs come from an equi-join of the standards measured on both instruments;
methods are fitted from joint Grams or channel statistics and applied as
literals (affine) or one matrix per batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import affine
from ..functions.storage import durable
from .gram import gram, long_stats
from .preprocess import multiply
from .zoo import Registry

TRANSFER = Registry("transfer method")


def pairs(slave: DataFrame, master: DataFrame, key: str = "std_id") -> DataFrame:
    """(key, s, m): spectra of the same standard on both instruments."""
    return slave.select(key, F.col("x").alias("s")).join(master.select(key, F.col("x").alias("m")), key)


def joint(pairs_df: DataFrame) -> tuple[float, np.ndarray, int]:
    """n and the raw cross products of [1, s, m]."""
    g = gram(pairs_df.select(F.concat("s", "m").alias("x")), y=None).m[:-1, :-1]
    return float(g[0, 0]), g, (len(g) - 1) // 2


@dataclass
class Affine:
    """x * scale + shift by channel."""

    scale: np.ndarray
    shift: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("x", affine(F.col("x"), self.scale, self.shift))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x * self.scale + self.shift


@dataclass
class Linear:
    """[1, x] times a ((p + 1), q) matrix; without an intercept its first row is zero."""

    matrix: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.matrix
        return multiply(df.withColumn("x", F.concat(F.array(F.lit(1.0)), "x")), m.T)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), x]) @ self.matrix


@TRANSFER.register("sbc", min_samples=2)
def slope_bias(df: DataFrame, slave: str = "y_slave", master: str = "y_master") -> tuple[float, float]:
    """Slope and intercept that correct slave predictions."""
    r = df.agg(F.regr_slope(master, slave), F.regr_intercept(master, slave)).first()
    return float(r[0]), float(r[1])


@TRANSFER.register("ds", min_samples=20)
def direct(pairs_df: DataFrame, ridge: float = 1e-8) -> Linear:
    """(S'S + r I)^-1 S'M, no intercept."""
    _, g, p = joint(pairs_df)
    f = np.linalg.solve(g[1 : p + 1, 1 : p + 1] + ridge * np.eye(p), g[1 : p + 1, p + 1 :])
    return Linear(np.vstack([np.zeros(p), f]))


@TRANSFER.register("pds", min_samples=5)
def piecewise(pairs_df: DataFrame, window: int = 5, ridge: float = 1e-8) -> Linear:
    """Each master channel from slave channels up to ``window`` away, with an intercept."""
    _, g, p = joint(pairs_df)
    out = np.zeros((p + 1, p))
    for j in range(p):
        on = np.concatenate([[0], np.arange(max(0, j - window), min(p, j + window + 1)) + 1])
        out[on, j] = np.linalg.solve(g[np.ix_(on, on)] + ridge * np.eye(len(on)), g[on, p + 1 + j])
    return Linear(out)


@TRANSFER.register("glsw", min_samples=5)
def weighting(pairs_df: DataFrame, lam: float = 1e-3) -> Linear:
    """Both instruments times (C + lam I)^-1/2, C the scaled cross product of the differences."""
    n, g, p = joint(pairs_df)
    ss, sm, mm = g[1 : p + 1, 1 : p + 1], g[1 : p + 1, p + 1 :], g[p + 1 :, p + 1 :]
    c = (ss + mm - sm - sm.T) / n
    trace = float(np.trace(c))
    if trace <= 0:
        w = np.eye(p)
    else:
        values, vectors = np.linalg.eigh(c * p / trace)
        w = (vectors / np.sqrt(np.maximum(values, 0) + lam)) @ vectors.T
    return Linear(np.vstack([np.zeros(p), w]))


@TRANSFER.register("meanvar", min_samples=2)
def mean_variance(pairs_df: DataFrame, eps: float = 1e-8) -> Affine:
    """Channel means and standard deviations of the slave made the master's."""
    n, g, p = joint(pairs_df)
    mean = g[0, 1:] / n
    sd = np.sqrt(np.maximum(np.diag(g)[1:] / n - mean**2, 0))
    scale = np.where(sd[:p] < eps, 1.0, sd[p:] / np.where(sd[:p] < eps, 1.0, sd[:p]))
    return Affine(scale, mean[p:] - scale * mean[:p])


def gain_offset(pairs_df: DataFrame) -> DataFrame:
    """(j, gain, offset) of the line master = gain slave + offset at each channel."""
    long = pairs_df.select(F.posexplode(F.arrays_zip("s", "m")).alias("j", "v")).select("j", F.col("v.s").alias("s"), F.col("v.m").alias("m"))
    sxx = F.greatest(F.regr_sxx("m", "s"), F.lit(1e-12))
    gain = F.regr_sxy("m", "s") / sxx
    return long.groupBy("j").agg(gain.alias("gain"), (F.avg("m") - gain * F.avg("s")).alias("offset"))


def residual_spectrum(slave: DataFrame, master: DataFrame) -> DataFrame:
    """(j, residual): master mean minus slave mean."""
    m = lambda df, name: df.select(F.posexplode("x").alias("j", "a")).groupBy("j").agg(F.avg("a").alias(name))
    return m(slave, "s").join(m(master, "m"), "j").select("j", (F.col("m") - F.col("s")).alias("residual"))


def wavelength_shift(axis, slave: DataFrame, master: DataFrame, max_shift: float = 5.0) -> float:
    """The lag, in nm, at which the centred mean spectra are most alike (cosine); the least of equal ones.

    It moves the slave onto the master: negative for a slave that lies at longer wavelengths.
    """
    step = float(np.median(np.diff(axis)))
    most = math.floor(max_shift / step) if step > 0 else 0
    if most < 1:
        return 0.0
    means = [long_stats(df).select("j", F.col("mean").alias("a")) for df in (slave, master)]
    own, other = (m.crossJoin(m.agg(F.avg("a").alias("level"))).select("j", (F.col("a") - F.col("level")).alias("a")) for m in means)
    size = F.broadcast(other.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("size")))
    lags = own.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select((F.col("j") + F.col("lag")).alias("j"), "lag", F.col("a").alias("s"))
    alike = lags.join(other, "j").groupBy("lag").agg(F.sum(F.col("s") * F.col("a")).alias("sm"), F.sum(F.col("s") * F.col("s")).alias("ss")).crossJoin(size)
    best = alike.select("lag", (F.col("sm") / (F.sqrt("ss") * F.col("size") + 1e-12)).alias("cosine")).orderBy(F.col("cosine").desc(), "lag").first()
    return best.lag * step


@dataclass(frozen=True)
class Advice:
    """A method for at least ``samples`` standards and a shift beyond ``shift`` nm."""

    method: str
    samples: float
    shift: float = -1.0
    window: int | None = None
    align: bool = False


#: Shifts beyond this (nm) call for alignment, and standards below this count for a slope and bias only.
ALIGN_NM, FEW = 0.5, 5


def advice(channels: int) -> list[Advice]:
    """What to use, most demanding first."""
    return [Advice("align_then_pds", FEW, ALIGN_NM, 5, True), Advice("ds", max(channels, FEW)), Advice("pds", FEW, window=5), Advice("sbc", 0)]


def recommend(axis, shift: float, n: int) -> dict:
    """The first advice whose thresholds n standards and the shift reach."""
    found = next(a for a in advice(len(axis)) if n >= a.samples and abs(shift) > a.shift)
    return {"method": found.method, "window": found.window, "need_alignment": abs(shift) > ALIGN_NM, "shift_nm": shift, "n_samples": n}


#: Picks of Kennard-Stone between two tables of running distances.
PICKS = 16


def kennard_stone(df: DataFrame, n_select: int, key: str = "sample_id") -> list:
    """Keys of a maximally spread subset, in key order; ties go to the least key.

    Each step is one native pass over every row's distance to the chosen set,
    kept as a column every PICKS picks; the first row is the farthest from all, from sums instead of pairs.
    """
    from .spectra import literal_distance

    n = df.count()
    if n_select >= n:
        return [r[0] for r in df.select(key).orderBy(key).collect()]
    sums = df.select(F.posexplode("x").alias("j", "a")).groupBy("j").agg(F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("ss")).orderBy("j").collect()
    s, ss = np.array([r.s for r in sums]), float(sum(r.ss for r in sums))
    # Sum of squared distances to all rows: n |x|^2 - 2 x.s + sum |x|^2.
    spread = F.aggregate(F.zip_with("x", F.array(*map(F.lit, s.tolist())), lambda v, t: n * v * v - 2 * v * t), F.lit(ss), lambda a, v: a + v)
    first = df.select(key, "x", spread.alias("d")).orderBy(F.col("d").desc(), key).first()
    chosen = [first[0]]
    rows = df.select(key, "x", F.lit(math.inf).alias("near"))
    nearest, last = F.col("near"), first["x"]
    while len(chosen) < n_select:
        nearest = F.least(nearest, literal_distance(last))
        if len(chosen) % PICKS == 0:
            # The running minimum becomes a column, so that no pick is measured again.
            rows, nearest = durable(rows.select(key, "x", nearest.alias("near"))), F.col("near")
        r = rows.select(key, "x", nearest.alias("d")).where(~F.col(key).isin(chosen)).orderBy(F.col("d").desc(), key).first()
        chosen.append(r[0])
        last = r["x"]
    return sorted(chosen)
