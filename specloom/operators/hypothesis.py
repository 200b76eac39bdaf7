"""Tests and intervals over groups of repeat measurements ``(group, v)``.

Group sums are native aggregates; only one row per group, or one in all,
reaches the driver for the critical value.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_ppf, chi2_sf, f_ppf, f_sf, norm_ppf, t_ppf


#: About so many rows share a bucket when a rank is sought.
RANK_ROWS = 4096


def order_statistics(df: DataFrame, ranks: dict[str, Column], group: str | None = None, v: str = "v") -> DataFrame:
    """([group,] n and a column for each of ``ranks``): values at ranks from 0, given over ``n``.

    Values are cut into buckets by range, buckets are counted, and only those
    that hold a rank are sorted: no group is sorted in one task. Nulls and NaN
    have no rank.
    """
    key = F.col(group) if group else F.lit(0)
    rows = df.select(key.alias("g"), F.col(v).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    span = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    many = F.ceil(F.col("n") / RANK_ROWS)
    bucket = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * many), many - 1)).otherwise(F.lit(0)).cast("long")
    placed = rows.join(span, "g").select("g", "v", "n", bucket.alias("b"))
    counts = placed.groupBy("g", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    wanted = counts.withColumn("before", upto).select("g", "b", "n", "c", "before", asked.alias("q")).where("q.rank >= before AND q.rank < before + c")
    wanted = wanted.select("g", "b", "n", "q.name", (F.col("q.rank") - F.col("before") + 1).alias("at"))
    nth = placed.join(wanted.select("g", "b").distinct(), ["g", "b"], "left_semi").select("g", "b", "v", F.row_number().over(Window.partitionBy("g", "b").orderBy("v")).alias("at"))
    hit = wanted.join(nth, ["g", "b", "at"]).groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return hit.withColumnRenamed("g", group) if group else hit.drop("g")


def group_variances(df: DataFrame, group: str = "group", v: str = "v") -> DataFrame:
    return df.groupBy(group).agg(F.count(v).alias("n"), F.var_samp(v).alias("variance"))


def cochran(df: DataFrame, alpha: float = 0.05, group: str = "group", v: str = "v") -> dict:
    r = group_variances(df, group, v).agg(F.max("variance"), F.sum("variance"), F.count("*"), F.avg("n")).first()
    c, k, nu = r[0] / r[1], r[2], r[3] - 1
    f = f_ppf(1 - alpha / k, nu, (k - 1) * nu)
    critical = f / (f + (k - 1))
    return {"statistic": c, "critical": critical, "reject": c > critical}


def bartlett(df: DataFrame, alpha: float = 0.05, group: str = "group", v: str = "v") -> dict:
    s = group_variances(df, group, v)
    d = F.col("n") - 1
    r = s.agg(F.count("*"), F.sum(d), F.sum(d * F.col("variance")), F.sum(d * F.log("variance")), F.sum(1 / d)).first()
    k, n, pooled = r[0], r[1], r[2] / r[1]
    stat = (n * math.log(pooled) - r[3]) / (1 + (r[4] - 1 / n) / (3 * (k - 1)))
    p = chi2_sf(stat, k - 1)
    return {"statistic": stat, "p": p, "reject": p < alpha}


def levene(df: DataFrame, alpha: float = 0.05, group: str = "group", v: str = "v") -> dict:
    """Around the medians: a one-way analysis of the absolute deviations."""
    middle = {"lower": F.floor((F.col("n") - 1) / 2), "upper": F.floor(F.col("n") / 2)}
    medians = order_statistics(df, middle, group, v).select(group, ((F.col("lower") + F.col("upper")) / 2).alias("__m"))
    z = df.join(medians, group).select(group, F.abs(F.col(v) - F.col("__m")).alias("z"))
    s = z.groupBy(group).agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("q"))
    r = s.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum(F.col("n") * F.col("q"))).first()
    k, n = r[0], r[1]
    between, within = r[3] - r[2] ** 2 / n, r[4]
    stat = (between / (k - 1)) / (within / (n - k))
    p = f_sf(stat, k - 1, n - k)
    return {"statistic": stat, "p": p, "reject": p < alpha}


def grubbs(df: DataFrame, alpha: float = 0.05, v: str = "v", key: str | None = None) -> dict:
    r = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    n, mean, sd = r
    if n < 3 or not sd:
        return {"statistic": 0.0, "critical": math.inf, "suspect": None, "reject": False}
    far = df.agg(F.max_by(key or v, F.abs(F.col(v) - mean)), F.max(F.abs(F.col(v) - mean))).first()
    t = t_ppf(1 - alpha / (2 * n), n - 2)
    critical = (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
    g = far[1] / sd
    return {"statistic": g, "critical": critical, "suspect": far[0], "reject": g > critical}


def omnibus(n: float, skew: float, kurtosis: float) -> tuple[float, float]:
    """K2 of population skewness and excess kurtosis, and its p."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = math.sqrt(2 * (b - 1)) - 1
    delta, a = 1 / math.sqrt(0.5 * math.log(w)), math.sqrt(2 / (w - 1))
    y = y or 1e-300
    z1 = delta * math.log(y / a + math.sqrt((y / a) ** 2 + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis + 3 - e) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a2 = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    d = 1 + x * math.sqrt(2 / (a2 - 4))
    z2 = (1 - 2 / (9 * a2) - math.copysign(((1 - 2 / a2) / abs(d)) ** (1 / 3), d)) / math.sqrt(2 / (9 * a2))
    k2 = z1 * z1 + z2 * z2
    return k2, chi2_sf(k2, 2)


def normality(df: DataFrame, alpha: float = 0.05, v: str = "v") -> dict:
    r = df.agg(F.count(v), F.skewness(v), F.kurtosis(v)).first()
    if r[0] < 8:
        raise ValueError("at least 8 values are needed")
    k2, p = omnibus(*r)
    return {"statistic": k2, "p": p, "reject": p < alpha}


def consistency_report(df: DataFrame, alpha: float = 0.05, group: str = "group", v: str = "v") -> dict:
    out = {"levene": levene(df, alpha, group, v), "cochran": cochran(df, alpha, group, v), "bartlett": bartlett(df, alpha, group, v)}
    if df.count() >= 8:
        out["normality"] = normality(df, alpha, v)
    out["homogeneous"] = not (out["levene"]["reject"] or out["cochran"]["reject"])
    out["advice"] = "pool the groups" if out["homogeneous"] else "inspect the group of largest variance before pooling"
    return out


def mean_interval(df: DataFrame, confidence: float = 0.95, sigma: float | None = None, v: str = "v") -> tuple[float, float]:
    n, mean, sd = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    if not n:
        return None, None
    q = 1 - (1 - confidence) / 2
    half = norm_ppf(q) * sigma / math.sqrt(n) if sigma is not None else _t_half(q, n, sd) / math.sqrt(n)
    return mean - half, mean + half


def _t_half(q: float, n: int, sd: float | None) -> float:
    """The t quantile times the deviation; a single value has no spread."""
    return t_ppf(q, n - 1) * sd if n > 1 else 0.0


def tolerance_interval(df: DataFrame, content: float = 0.95, confidence: float = 0.95, kind: str = "content", v: str = "v") -> tuple[float, float]:
    """``content``, ``expectation`` or ``nonparametric`` (order statistics)."""
    n, mean, sd, low, high = df.agg(F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)).first()
    if n < 2:
        return low, high
    z = norm_ppf((1 + content) / 2)
    if kind == "content":
        half = z * math.sqrt(1 + 1 / n) * math.sqrt((n - 1) / chi2_ppf(1 - confidence, n - 1)) * sd
    elif kind == "expectation":
        half = z * sd
    elif kind == "nonparametric":
        outside = (n - min(n, math.ceil(n * content))) // 2
        r = order_statistics(df, {"low": F.lit(outside), "high": F.col("n") - 1 - outside}, None, v).first()
        return r.low, r.high
    else:
        raise ValueError("kind must be content, expectation or nonparametric")
    return mean - half, mean + half


def prediction_interval(df: DataFrame, confidence: float = 0.95, n_future: int = 1, v: str = "v") -> tuple[float, float]:
    n, mean, sd = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    if not n:
        return None, None
    half = _t_half(1 - (1 - confidence) / 2, n, sd) * math.sqrt(1 / n_future + 1 / n)
    return mean - half, mean + half


def precision_summary(df: DataFrame, confidence: float = 0.95, v: str = "v") -> dict:
    n, mean, sd = df.agg(F.count(v), F.avg(v), F.stddev_samp(v)).first()
    sd = sd or 0.0
    return {"n": n, "mean": mean, "sd": sd, "rsd": sd / abs(mean) if mean else float(np.nan), "ci": mean_interval(df, confidence, None, v), "ti": tolerance_interval(df, confidence=confidence, v=v)}
