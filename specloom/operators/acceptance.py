"""Acceptance of predictions: ``(…, y_true, y_pred, day_idx)`` tables, one pass each.

Every aggregate takes grouping keys, so one job serves all models, parameters
or days. Sums are partial on the map side; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import WaterParam, acceptable, water_class


def T() -> Column:  # noqa: N802
    return F.col("y_true")


def P() -> Column:  # noqa: N802
    return F.col("y_pred")


def finite(df: DataFrame) -> DataFrame:
    return df.where(T().isNotNull() & P().isNotNull() & ~F.isnan(T()) & ~F.isnan(P()))


def acceptance_rate(df: DataFrame, param: WaterParam, *keys: str) -> DataFrame:
    """NaN-free: no rows give a null rate."""
    return df.groupBy(*keys).agg(F.avg(acceptable(T(), P(), param).cast("double")).alias("acceptance"))


def confusion(df: DataFrame, param: WaterParam, *keys: str) -> DataFrame:
    """(keys, true_class, pred_class, n): every pair of classes, zeros included."""
    counts = df.groupBy(*keys, water_class(T(), param.ranges).alias("true_class"), water_class(P(), param.ranges).alias("pred_class")).agg(F.count("*").alias("n"))
    classes = F.sequence(F.lit(0), F.lit(len(param.ranges)))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("true_class", F.explode(classes)).withColumn("pred_class", F.explode(classes))
    return grid.join(counts, [*keys, "true_class", "pred_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def r2(truth: Column | None = None, pred: Column | None = None) -> Column:
    """1 - SSres / SStot as an aggregate; null without variance."""
    truth, pred = T() if truth is None else truth, P() if pred is None else pred
    spread = F.var_pop(truth) * F.count(truth)
    return F.when(spread > 0, 1 - F.sum((truth - pred) * (truth - pred)) / spread)


def daily_r2(df: DataFrame, *keys: str, day: str = "day_idx") -> DataFrame:
    """Days of two samples and more."""
    return df.groupBy(*keys, day).agg(F.count("*").alias("n"), r2().alias("r2")).where("n >= 2")


def alarm(df: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """accuracy, false_alarm, missed_alarm and the four counts at ``>= threshold``."""
    t, p = T() >= threshold, P() >= threshold
    cells = {"tp": t & p, "fp": ~t & p, "fn": t & ~p, "tn": ~t & ~p}
    out = df.groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in cells)
    return out.select(*keys, rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(fp, fp + tn).alias("false_alarm"), rate(fn, fn + tp).alias("missed_alarm"), *cells)


def errors(df: DataFrame, *keys: str) -> DataFrame:
    """n, rmse, mae, bias, r2 and mape (truths of zero skipped) of each group."""
    e = P() - T()
    ratio = F.when(T() != 0, F.abs(e / T()))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        r2().alias("r2"),
        F.avg(ratio).alias("mape"),
    )


def acceptance_report(df: DataFrame, param: WaterParam, *keys: str, day: str | None = None) -> dict[str, DataFrame]:
    """Frames ``errors`` (with the acceptance), ``confusion``, ``alarm`` and, with a day, ``daily_r2``."""
    df = finite(df)
    acceptance = acceptance_rate(df, param, *keys)
    both = errors(df, *keys)
    both = both.join(acceptance, list(keys)) if keys else both.crossJoin(acceptance)
    out = {"errors": both, "confusion": confusion(df, param, *keys)}
    if param.review_upper is not None:
        out["alarm"] = alarm(df, float(param.ranges[-1]), *keys)
    if day:
        out["daily_r2"] = daily_r2(df, *keys, day=day)
    return out
