"""Native expressions over ``array<double>`` spectra; nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    """A constant vector; sized by the wavelength axis, not by the data."""
    return F.expr("cast(array(" + ", ".join(_sql(float(v)) for v in values) + ") as array<double>)")


def _sql(v: float) -> str:
    return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def moments(x: Column) -> Column:
    """struct(n, mean, m2) in one pass; m2 is the sum of squares around the mean."""

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        move = v - a["mean"]
        mean = a["mean"] + move / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + move * (v - mean)).alias("m2"))

    return F.aggregate(x, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), step)


def sd(x: Column, ddof: int = 0) -> Column:
    m = moments(x)
    return F.sqrt(m["m2"] / (F.size(x) - ddof))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where a lambda in the body uses it.

    An expression named inside a lambda would be computed anew for each element.
    """
    return F.transform(F.array(value), body)[0]


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def affine(x: Column, scale: Sequence[float], shift: Sequence[float]) -> Column:
    """x * scale + shift, elementwise."""
    pairs = F.arrays_zip(literal(scale).alias("a"), literal(shift).alias("b"))
    return F.zip_with(x, pairs, lambda v, p: v * p["a"] + p["b"])


def gather(x: Column, index: Sequence[int]) -> Column:
    """The channels ``index`` (from 0) of a spectrum, in that order."""
    return F.transform(F.array(*[F.lit(int(j) + 1) for j in index]), lambda j: F.element_at(x, j))


def clean(x: Column) -> Column:
    """NaN to null, for a scalar."""
    return F.when(~F.isnan(x), x)
