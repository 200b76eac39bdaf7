"""Sufficient statistics: n, sums and cross products of spectra and targets.

One aggregate serves every linear model. Arrow batches add up their products in
each task, tasks' partial sums are added by blocks of matrix rows, so the driver
receives one (p + 2)-square matrix per group however many samples there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Matrix rows that are added up together, in one task each.
BLOCK_ROWS = 64


@dataclass
class Gram:
    """Sums over samples of [1, x, y]'[1, x, y]; grams add and subtract."""

    m: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.m + other.m)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.m - other.m)

    @property
    def n(self) -> float:
        return float(self.m[0, 0])

    @property
    def mean_x(self) -> np.ndarray:
        return self.m[0, 1:-1] / self.n

    @property
    def mean_y(self) -> float:
        return float(self.m[0, -1] / self.n)

    def centred(self) -> Centred:
        c = self.m - np.outer(self.m[0], self.m[0]) / self.n
        return Centred(self.n, self.mean_x, self.mean_y, c[1:-1, 1:-1], c[1:-1, -1], float(c[-1, -1]))

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> Gram:
        z = np.column_stack([np.ones(len(x)), x, y])
        return Gram(z.T @ z)


@dataclass
class Centred:
    n: float
    mean_x: np.ndarray
    mean_y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def take(self, index: np.ndarray) -> Centred:
        """The statistics of a subset of channels: no rescan."""
        return Centred(self.n, self.mean_x[index], self.mean_y, self.xx[np.ix_(index, index)], self.xy[index], self.yy)


def grams(df: DataFrame, group: str | None = None, x: str = "x", y: str | None = "y", design: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> dict:
    """A Gram for each value of ``group`` (None: one, under None). Groups are folds or days: few.

    ``design`` makes the matrix whose cross products are summed of a batch's x and y; [1, x, y] without it.
    """
    cols = [F.col(x).alias("x"), (F.col(y).cast("double") if y and y in df.columns else F.lit(0.0)).alias("y"), (F.col(group) if group else F.lit(0)).cast("long").alias("g")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            xs, ys = np.stack(b["x"].to_numpy()).astype(float), b["y"].to_numpy(float)
            z = design(xs, ys) if design else np.column_stack([np.ones(len(b)), xs, ys])
            for g in np.unique(b["g"].to_numpy()):
                own = z[b["g"].to_numpy() == g]
                sums[int(g)] = sums.get(int(g), 0) + own.T @ own
        for g, m in sums.items():
            blocks = [m[i : i + BLOCK_ROWS].ravel() for i in range(0, len(m), BLOCK_ROWS)]
            yield pd.DataFrame({"g": g, "i": np.arange(len(blocks)), "v": blocks})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": part["g"].iloc[:1], "i": part["i"].iloc[:1], "v": [np.sum(np.stack(part["v"].to_numpy()), axis=0)]})

    schema = "g long, i long, v array<double>"
    out: dict = {}
    for r in df.select(*cols).mapInPandas(partial, schema).groupBy("g", "i").applyInPandas(add, schema).orderBy("g", "i").collect():
        out.setdefault(r.g if group else None, []).append(r.v)
    flat = {g: np.concatenate(m) for g, m in out.items()}
    return {g: Gram(m.reshape(int(len(m) ** 0.5), -1)) for g, m in flat.items()}


def gram(df: DataFrame, x: str = "x", y: str | None = "y", design: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Gram:
    found = grams(df, None, x, y, design)
    if None not in found:
        raise ValueError("no rows to sum over")
    return found[None]


def long_stats(df: DataFrame, *keys: str, x: str = "x") -> DataFrame:
    """(keys, j, n, mean, sd_pop, sd): native statistics by channel."""
    long = df.select(*keys, F.posexplode(x).alias("j", "a"))
    return long.groupBy(*keys, "j").agg(F.count("a").alias("n"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd_pop"), F.stddev_samp("a").alias("sd"))


def column_stats(df: DataFrame, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd of each channel, on the driver (one spectrum long each)."""
    rows = long_stats(df, x=x).orderBy("j").collect()
    return np.array([r["mean"] for r in rows], float), np.array([r["sd_pop"] for r in rows], float)
