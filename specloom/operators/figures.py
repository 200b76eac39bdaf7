"""The data behind each figure, as frames: drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .acceptance import P, T
from .mspc import Mspc, explained_variance
from .preprocess import multiply
from .spectra import to_long


def spectra_points(df: DataFrame, axis) -> DataFrame:
    return to_long(df, axis)


def derivative_points(df: DataFrame, axis, window: int = 15, order: int = 3, deriv: int = 1) -> DataFrame:
    return to_long(multiply(df, kernels.smoothing_matrix(len(axis), window, order, deriv)), axis)


def difference_points(a: DataFrame, b: DataFrame, axis, key: str = "sample_id") -> DataFrame:
    """Channelwise b - a of the same samples."""
    joined = a.select(key, F.col("x").alias("__a")).join(b.select(key, F.col("x").alias("__b")), key)
    return to_long(joined.select(key, F.zip_with("__a", "__b", lambda u, v: v - u).alias("x")), axis)


def fitted_points(predictions: DataFrame) -> DataFrame:
    return predictions.select("*", (P() - T()).alias("residual"))


def variance_points(df: DataFrame) -> DataFrame:
    shares = explained_variance(df)
    return df.sparkSession.createDataFrame([(k + 1, float(v), float(shares[: k + 1].sum())) for k, v in enumerate(shares)], "component int, share double, cumulative double")


def contribution_points(df: DataFrame, model: Mspc, axis, key: str = "sample_id") -> DataFrame:
    return to_long(model.monitor(df).select(key, F.col("contribution").alias("x")), axis)


def linearity_points(r2: DataFrame, axis) -> DataFrame:
    return r2.withColumn("nm", F.element_at(F.array(*[F.lit(float(v)) for v in axis]), F.col("j") + 1))
