"""River station inference: two profiles of smoothing, scaling and guards."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import affine, dot, literal
from ..operators import guards
from ..operators.gram import gram
from ..operators.preprocess import global_standardize, river_smooth, snv

# Detection limits and upper limits of both profiles, and the
# turbidity that divides the model sets.
PCA_LIMITS = {"TN": (0.5, 4), "COD": (2, 20), "KMNO": (0.5, 8), "TUR": (0.5, 70), "TP": (0.02, 1.2), "AN": (0.025, 1.5)}
RANGE_LIMITS = {"KMNO": (0.5, 20), "TN": (0.2, 8), "TUR": (0.5, 150), "TP": (0.005, 5), "AN": (0.015, 5)}
TURBIDITY_BRANCH = 20.0


def process_range(df: DataFrame) -> DataFrame:
    """Smoothed spectra, each standardised by itself."""
    return river_smooth(df).withColumn("x", snv(F.col("x")))


def process_pca(df: DataFrame, k: int = 3) -> DataFrame:
    """Smoothed, standardised as a whole batch, on its leading components (largest loading positive)."""
    ready = global_standardize(river_smooth(df))
    c = gram(ready.select("x"), y=None).centred()
    v = np.linalg.eigh(c.xx)[1][:, ::-1][:, :k].T
    v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    centred = ready.withColumn("x", affine(F.col("x"), np.ones(len(c.mean_x)), -c.mean_x))
    return centred.withColumn("x", F.array(*[dot(F.col("x"), literal(p)) for p in v]))


def guard(value, limits: tuple[float, float]):
    """At most the detection limit: half of it; above the upper one: that."""
    return guards.range_limit(guards.detection_limit(value, limits[0]), limits[1])


def predict_parameters(df: DataFrame, models: dict[str, list[tuple[list[float], float]]], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """A guarded column per parameter, the mean of its models; TN is never below AN."""
    for name, members in models.items():
        parts = [dot(F.col("x"), literal(coef)) + intercept for coef, intercept in members]
        df = df.withColumn(name, guard(reduce(lambda a, b: a + b, parts) / len(parts), limits[name]))
    return df.withColumn("TN", F.greatest("TN", "AN")) if {"TN", "AN"} <= set(models) else df


def predict_branch(df: DataFrame, clear: dict, wide: dict, limits: dict[str, tuple[float, float]] = RANGE_LIMITS) -> DataFrame:
    """Chooses the model set by the batch's mean turbidity, as the ``wide`` set's model has it.

    A batch with any value above 1 takes KMNO from the wide set in either case.
    One aggregate decides, so the batch is read twice and never collected; an
    empty batch counts as clear.
    """
    (coef, intercept), *_ = wide["TUR"]
    turbidity = guard(dot(F.col("x"), literal(coef)) + intercept, limits["TUR"])
    mean, top = df.agg(F.avg(turbidity), F.max(F.array_max("x"))).first()
    models = dict(clear if mean is None or mean <= TURBIDITY_BRANCH else wide)
    if top is not None and top > 1 and "KMNO" in wide:
        models["KMNO"] = wide["KMNO"]
    return predict_parameters(df, models, limits)
