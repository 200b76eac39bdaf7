"""Control charts and other ordered operators over ``(series, seq, value)``.

A series is partitioned by its id and ordered by ``seq``; sums run as window
frames. CUSUM has a closed form in running sums, EWMA one within blocks of a
series. Numbering a series sorts it in one task, which may spill.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import norm_sf


def _order(series: str, seq: str):
    return Window.partitionBy(series).orderBy(seq)


def effective_size(df: DataFrame, series: str = "series", seq: str = "seq", value: str = "value") -> DataFrame:
    """(series, n, mean, sd, n_eff): sample size corrected for lag-1 correlation."""
    whole = Window.partitionBy(series)
    c = df.withColumn("__c", F.col(value) - F.avg(value).over(whole)).withColumn("__l", F.lag("__c").over(_order(series, seq)))
    out = c.groupBy(series).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.sum(F.col("__c") * F.col("__l")).alias("num"), F.sum(F.col("__c") * F.col("__c")).alias("den"))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0)))
    n_eff = F.when(F.col("n") < 3, F.col("n").cast("double")).otherwise(F.greatest(F.lit(1.0), F.col("n") * (1 - rho) / (1 + rho)))
    return out.select(series, "n", "mean", "sd", n_eff.alias("n_eff"))


def shewhart_limits(df: DataFrame, k: float = 3.0, autocorr: bool = True, series: str = "series", seq: str = "seq", value: str = "value") -> DataFrame:
    """(series, center, lcl, ucl): limits of the mean."""
    s = effective_size(df, series, seq, value)
    n = F.greatest(F.col("n_eff") if autocorr else F.col("n").cast("double"), F.lit(1.0))
    half = k * F.coalesce("sd", F.lit(0.0)) / F.sqrt(n)
    return s.select(series, F.col("mean").alias("center"), (F.col("mean") - half).alias("lcl"), (F.col("mean") + half).alias("ucl"))


def cusum(df: DataFrame, target: float | Column | None = None, k: float = 0.5, h: float = 5.0, series: str = "series", seq: str = "seq", value: str = "value") -> DataFrame:
    """(series, seq, value, c_pos, c_neg, alarm); the first point only starts the sums.

    With S the running sum of z - k from the second point on, the upper sum is
    S minus its running minimum (and zero), the lower one mirrors it.
    """
    whole, order = Window.partitionBy(series), _order(series, seq)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    center = F.avg(value).over(whole) if target is None else (target if isinstance(target, Column) else F.lit(float(target)))
    spread = F.stddev_samp(value).over(whole)
    z = F.when(spread > 0, (F.col(value) - center) / spread).otherwise(0.0)
    first = F.row_number().over(order) == 1
    out = df.withColumn("__z", z).withColumn("__first", first)
    out = out.withColumn("__s", F.sum(F.when(F.col("__first"), 0.0).otherwise(F.col("__z") - k)).over(run))
    out = out.withColumn("__t", F.sum(F.when(F.col("__first"), 0.0).otherwise(F.col("__z") + k)).over(run))
    out = out.withColumn("c_pos", F.col("__s") - F.min("__s").over(run)).withColumn("c_neg", F.col("__t") - F.max("__t").over(run))
    return out.select(series, seq, value, "c_pos", "c_neg", ((F.col("c_pos") > h) | (F.col("c_neg") < -h)).alias("alarm"))


def ewma_values(x: np.ndarray, lam: float, k: float, center: float, sd: float) -> tuple[np.ndarray, np.ndarray]:
    z, out = center, np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        z = lam * v + (1 - lam) * z
        out[i] = z
    i = np.arange(1, len(x) + 1)
    return out, k * sd * np.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * i)))


def ewma(df: DataFrame, lam: float = 0.2, k: float = 3.0, target: float | None = None, series: str = "series", seq: str = "seq", value: str = "value") -> DataFrame:
    """(series, seq, value, ewma, lcl, ucl, alarm) with time-varying limits.

    A series is cut into blocks so long that what a block's start weighs at its
    end is below 1e-30 of it: within a block the recursion is a running sum of
    value / (1 - lam)^i, and only the end of the block before is carried over.
    """
    whole, order = Window.partitionBy(series), _order(series, seq)
    fade = 1.0 - lam
    center = F.avg(value).over(whole) if target is None else F.lit(float(target))
    spread = F.coalesce(F.stddev_samp(value).over(whole), F.lit(0.0))
    out = df.select(series, seq, F.col(value).cast("double").alias(value))
    out = out.select("*", center.alias("__c"), spread.alias("__s"), F.row_number().over(order).alias("__i"))
    if fade <= 0:
        out = out.withColumn("ewma", F.col(value))
    else:
        size = math.ceil(30 * math.log(10) / -math.log(fade))
        out = out.withColumn("__b", F.floor((F.col("__i") - 1) / size)).withColumn("__p", (F.col("__i") - 1) % size + 1)
        run = Window.partitionBy(series, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        power = F.pow(F.lit(fade), F.col("__p"))
        out = out.withColumn("__own", lam * power * F.sum(F.col(value) / power).over(run))
        ends = out.where(F.col("__p") == size).select(F.col(series).alias("__k"), (F.col("__b") + 1).alias("__n"), F.col("__own").alias("__e"))
        out = out.join(ends, F.col(series).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__n")), "left")
        out = out.withColumn("ewma", F.col("__own") + power * F.when(F.col("__b") == 0, F.col("__c")).otherwise(F.col("__e")))
    half = k * F.col("__s") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(max(fade, 0.0)), 2 * F.col("__i"))))
    out = out.withColumn("__h", half)
    return out.select(series, seq, value, "ewma", (F.col("__c") - F.col("__h")).alias("lcl"), (F.col("__c") + F.col("__h")).alias("ucl"), (F.abs(F.col("ewma") - F.col("__c")) > F.col("__h")).alias("alarm"))


def arl0(k: float) -> float:
    """Expected run length before a false alarm of two-sided k-sigma limits."""
    return 1 / (2 * norm_sf(k))


def unimodal(df: DataFrame, series: str = "series", seq: str = "seq", value: str = "value") -> DataFrame:
    """Values made to rise up to the first maximum and to fall after it."""
    order = _order(series, seq)
    peak = df.groupBy(series).agg(F.min_by(F.col(seq), F.struct(-F.col(value), F.col(seq))).alias("__peak"))
    up = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.when(F.col(seq) > F.col("__peak"), F.col(value))
    down = F.max(after).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return df.join(peak, series).select(series, seq, F.when(F.col(seq) <= F.col("__peak"), up).otherwise(down).alias(value))


def islands(df: DataFrame, keep: Column, series: str = "series", seq: str = "seq") -> DataFrame:
    """(series, first, last, n): maximal runs of consecutive rows where ``keep``."""
    order = _order(series, seq)
    out = df.withColumn("__i", F.row_number().over(order)).where(keep)
    out = out.withColumn("__g", F.col("__i") - F.row_number().over(order))
    return out.groupBy(series, "__g").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n")).drop("__g")


def day_folds(days: DataFrame, scheme: str = "expanding", window: int | None = None, day: str = "day_idx") -> DataFrame:
    """(fold, day_idx, role): train and test days by the ordinal of distinct days.

    ``logo`` trains on all other days, ``expanding`` on all earlier ones,
    ``rolling`` on the ``window`` days before, days without so many skipped.
    Days number far fewer than samples; samples join by day.
    """
    if scheme == "rolling" and not (window and window >= 1):
        raise ValueError("a rolling scheme needs a window of one day or more")
    d = days.select(day).distinct().withColumn("o", F.dense_rank().over(Window.orderBy(day)))
    a, b = d.select(F.col(day).alias("test_day"), F.col("o").alias("fold")), d
    rule = {"logo": F.col("o") != F.col("fold"), "expanding": F.col("o") < F.col("fold")}.get(scheme)
    if scheme == "rolling":
        rule = (F.col("o") < F.col("fold")) & (F.col("o") >= F.col("fold") - window) & (F.col("fold") > window)
    if rule is None:
        raise ValueError(f"unknown scheme {scheme!r}")
    train = a.join(b, rule).select("fold", day, F.lit("train").alias("role"))
    tests = a.join(train.select("fold").distinct(), "fold", "left_semi").select("fold", F.col("test_day").alias(day), F.lit("test").alias("role"))
    return train.unionByName(tests)


def kfold(n: int, folds: int = 5, seed: int = 0) -> list[np.ndarray]:
    """Test indices of shuffled folds: a seeded permutation cut into near-equal parts."""
    if not 2 <= folds <= n:
        raise ValueError("folds must lie between 2 and the number of samples")
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return np.array_split(order, folds)
