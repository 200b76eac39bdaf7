"""Multivariate process monitoring: T2 and squared prediction error.

Fitting needs one Gram (loadings, score variances) and one native pass for the
error's moments; scoring is a projection with literals of the model's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, dot, literal
from ..functions.special import chi2_ppf, f_ppf
from ..functions.storage import durable
from .gram import gram


@dataclass
class Mspc:
    mean: np.ndarray
    loadings: np.ndarray  # (k, p)
    variances: np.ndarray  # of the scores, sample
    n: float
    alpha: float
    t2_limit: float = float("inf")
    spe_limit: float = float("inf")

    def transform(self, df: DataFrame, batch_n: bool = False) -> DataFrame:
        """``df`` with scores, residual, t2 and spe.

        The score covariance is the training set's; ``batch_n`` rescales it by
        the number of scored rows instead, as a batch evaluated by itself does.
        """
        centred = F.zip_with("x", literal(self.mean), lambda a, m: a - m)
        k = len(self.loadings)

        def parts(c: Column) -> Column:
            scores = F.array(*[dot(c, literal(p)) for p in self.loadings])
            return F.struct(scores.alias("t"), c.alias("c"))

        def rebuilt(s: Column) -> Column:
            rest = s["c"]
            for i in range(k):
                rest = F.zip_with(rest, literal(self.loadings[i]), _minus(s["t"][i]))
            return F.struct(s["t"].alias("scores"), rest.alias("residual"))

        both = bound(bound(centred, parts), rebuilt)
        out = df.withColumn("__b", both).select("*", "__b.scores", "__b.residual").drop("__b")
        t2 = sum(F.col("scores")[k] ** 2 / float(max(v, 1e-300)) for k, v in enumerate(self.variances))
        if batch_n:
            scale = (F.greatest(F.count(F.lit(1)).over(_all()) - 1, F.lit(1))) / float(max(self.n - 1, 1))
            t2 = t2 * scale
        return out.withColumn("t2", t2).withColumn("spe", dot(F.col("residual"), F.col("residual")))

    def monitor(self, df: DataFrame) -> DataFrame:
        """``transform`` with limits, alarms and each channel's share of the error."""
        out = self.transform(df)
        return out.select(
            "*",
            F.lit(self.t2_limit).alias("t2_limit"),
            F.lit(self.spe_limit).alias("spe_limit"),
            (F.col("t2") > self.t2_limit).alias("t2_alarm"),
            (F.col("spe") > self.spe_limit).alias("spe_alarm"),
            F.transform("residual", lambda r: r * r).alias("contribution"),
        )


def _minus(t):
    return lambda a, b: a - t * b


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def t2_limit(k: int, n: float, alpha: float) -> float:
    return k * (n - 1) / (n - k) * f_ppf(1 - alpha, k, n - k) if n > k else float("inf")


def spe_limit(mean: float, variance: float, alpha: float) -> float:
    """Weighted chi-square matched to the error's mean and variance."""
    if not variance > 0:
        return mean
    return variance / (2 * mean) * chi2_ppf(1 - alpha, 2 * mean**2 / variance)


def fit(df: DataFrame, n_components: int = 5, alpha: float = 0.05) -> Mspc:
    c = gram(df.select("x"), y=None).centred()
    k = int(min(n_components, c.n, len(c.mean_x)))
    values, vectors = np.linalg.eigh(c.xx)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    model = Mspc(c.mean_x, (vectors * sign).T, np.maximum(values, 0) / max(c.n - 1, 1), c.n, alpha)
    model.t2_limit = t2_limit(k, c.n, alpha)
    r = model.transform(df.select("x")).agg(F.avg("spe"), F.var_samp("spe")).first()
    model.spe_limit = spe_limit(r[0], r[1] or 0.0, alpha)
    return model


def explained_variance(df: DataFrame) -> np.ndarray:
    """Shares of the total variance by component, descending."""
    values = np.maximum(np.linalg.eigvalsh(gram(df.select("x"), y=None).centred().xx)[::-1], 0)
    return values / values.sum()


def judged(df: DataFrame, n_components: int = 5, alpha: float = 0.05, by: str = "any", model: Mspc | None = None) -> DataFrame:
    """All rows with their ratio to the limit, unordered."""
    model = model or fit(df, n_components, alpha)
    out = model.monitor(df)
    t2, spe = F.col("t2") / F.col("t2_limit"), F.col("spe") / F.col("spe_limit")
    ratio = {"t2": t2, "spe": spe, "any": F.greatest(t2, spe)}.get(by)
    if ratio is None:
        raise ValueError("by must be t2, spe or any")
    return out.withColumn("ratio", ratio).withColumn("outlier", F.col("ratio") > 1)


def flag_outliers(df: DataFrame, n_components: int = 5, alpha: float = 0.05, by: str = "any", model: Mspc | None = None) -> DataFrame:
    """All rows with their ratio to the limit, worst first; none is deleted."""
    out = judged(df, n_components, alpha, by, model)
    return out.orderBy(F.col("ratio").desc(), *(["sample_id"] if "sample_id" in df.columns else []))


def clean_loop(df: DataFrame, rounds: int = 3, key: str = "sample_id", **options) -> tuple[DataFrame, list[int]]:
    """Flag, remove, refit, until no row is flagged; also how many keys went each round.

    The flagged keys stay a table, so any number of them may go.
    """
    gone = []
    for _ in range(rounds):
        flagged = durable(judged(df, **options).where("outlier").select(key).distinct())
        gone.append(flagged.count())
        if not gone[-1]:
            break
        df = df.join(flagged, key, "left_anti")
    return df, gone
