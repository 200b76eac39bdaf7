"""The spectra table: ``(sample_id, ..., x array<double>)`` on a shared axis.

The axis (wavelength of each channel) is a list on the driver, as long as one
spectrum. Two layouts are used: the array form, and the long form
``(sample_id, j, nm, a)`` for statistics by wavelength.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean, doubles


class ShapeError(ValueError):
    """Spectra do not fit their axis."""


def spectra(df: DataFrame, sample_id: str, x: str, *meta: str) -> DataFrame:
    """(sample_id, meta..., x array<double>)."""
    return df.select(F.col(sample_id).alias("sample_id"), *meta, doubles(x).alias("x"))


def validate(df: DataFrame, axis: Sequence[float]) -> DataFrame:
    """Fails, when run, on a spectrum whose length isn't the axis's."""
    p = len(axis)
    fits = F.assert_true(F.size("x") == p, F.concat(F.lit(f"spectrum of {p} channels expected, got "), F.size("x").cast("string")))
    return df.where(fits.isNull())


def to_long(df: DataFrame, axis: Sequence[float]) -> DataFrame:
    """(…, j, nm, a): one row per channel, NaN as null."""
    nm = F.element_at(F.array(*[F.lit(float(v)) for v in axis]), F.col("j") + 1)
    rest = [c for c in df.columns if c != "x"]
    return df.select(*rest, F.posexplode("x").alias("j", "a")).withColumn("a", clean(F.col("a"))).withColumn("nm", nm)


def to_arrays(long: DataFrame, *keys: str) -> DataFrame:
    """Back to one array per key, ordered by channel."""
    pairs = F.array_sort(F.collect_list(F.struct("j", "a")))
    return long.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.expr("transform(p, q -> q.a)").alias("x"))


def select(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def select_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def clip_wavelengths(df: DataFrame, axis: Sequence[float], low: float, high: float) -> tuple[DataFrame, list[float]]:
    """Channels whose wavelength lies in the closed interval; the axis must be sorted."""
    keep = [j for j, v in enumerate(axis) if low <= v <= high]
    if not keep:
        return df.withColumn("x", F.array().cast("array<double>")), []
    first, last = keep[0], keep[-1]
    return df.withColumn("x", F.slice("x", first + 1, last - first + 1)), list(axis[first : last + 1])


def trim_bands(df: DataFrame, axis: Sequence[float], edge: int = 10) -> tuple[DataFrame, list[float]]:
    """Without ``edge`` channels at either end."""
    n = max(0, len(axis) - 2 * edge)
    return df.withColumn("x", F.slice("x", edge + 1, n)), list(axis[edge : edge + n])


def with_values(df: DataFrame, x: Column) -> DataFrame:
    return df.withColumn("x", x)


def sort_by(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise KeyError(column)
    return df.orderBy(column, "sample_id")


def instrument_ids(df: DataFrame, column: str = "instrument_id") -> DataFrame:
    return df.select(F.col(column).cast("string").alias("instrument_id")).distinct().orderBy("instrument_id")


def shape(df: DataFrame, axis: Sequence[float]) -> dict:
    """n_samples, n_wavelengths and the median step of the axis."""
    step = float(np.median(np.diff(axis))) if len(axis) > 1 else 0.0
    return {"n_samples": df.count(), "n_wavelengths": len(axis), "step": step}


def labelled(df: DataFrame, labels: DataFrame, param: str | None = None) -> DataFrame:
    """Spectra joined with their labels; rows without a finite label go."""
    y = labels if param is None else labels.where(F.col("param") == param)
    y = y.select("sample_id", F.col("y").cast("double").alias("y"))
    return df.join(y, "sample_id").where(F.col("y").isNotNull() & ~F.isnan("y"))


def literal_distance(x: Sequence[float]) -> Column:
    """Squared distance of each spectrum to a fixed one."""
    other = F.array(*[F.lit(float(v)) for v in x])
    return F.aggregate(F.zip_with("x", other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
