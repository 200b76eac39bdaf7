"""Control charts and daily acceptance on streams.

A stream has no whole-series mean, so charts take target and sd from a
reference period. State is one small row per series: the sums of the last
point. Spectra are scored by plain projections; see :mod:`specloom.plans.serve`
and :class:`specloom.operators.mspc.Mspc`, whose transforms accept streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.acceptance import P, T, r2

CHART = "series string, seq timestamp, value double, c_pos double, c_neg double, ewma double, cusum_alarm boolean, ewma_alarm boolean"
STATE = "c_pos double, c_neg double, ewma double, n long"


def advance(rows: pd.DataFrame, state: tuple, target: float, sd: float, k: float, h: float, lam: float, width: float) -> tuple[pd.DataFrame, tuple]:
    """The charts of rows in ``seq`` order from a state, and the state after them.

    As in batch, the first point starts the CUSUM sums and moves the EWMA.
    """
    c_pos, c_neg, z, n = state
    out = []
    for seq, v in zip(rows["seq"], rows["value"]):
        n += 1
        if n > 1:
            u = (v - target) / sd if sd > 0 else 0.0
            c_pos, c_neg = max(0.0, c_pos + u - k), min(0.0, c_neg + u + k)
        z = lam * v + (1 - lam) * z
        half = width * sd * (lam / (2 - lam) * (1 - (1 - lam) ** (2 * n))) ** 0.5
        out.append((seq, v, c_pos, c_neg, z, c_pos > h or c_neg < -h, abs(z - target) > half))
    frame = pd.DataFrame(out, columns=["seq", "value", "c_pos", "c_neg", "ewma", "cusum_alarm", "ewma_alarm"])
    return frame, (c_pos, c_neg, z, n)


def control_chart(stream: DataFrame, target: float, sd: float, k: float = 0.5, h: float = 5.0, lam: float = 0.2, width: float = 3.0) -> DataFrame:
    """Charts of ``stream(series, seq timestamp, value)``; rows of a batch are put in order of ``seq``, ties of ``value``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["seq", "value"], kind="stable")
        now = state.get if state.exists else (0.0, 0.0, float(target), 0)
        out, after = advance(rows, tuple(now), target, sd, k, h, lam, width)
        state.update(after)
        out.insert(0, "series", key[0])
        yield out

    rows = stream.select(F.col("series").cast("string").alias("series"), "seq", F.col("value").cast("double").alias("value"))
    return rows.groupBy("series").applyInPandasWithState(run, CHART, STATE, "append", GroupStateTimeout.NoTimeout)


def timed(stream: DataFrame, ts: str) -> DataFrame:
    """``ts`` as a time with a zone (the session's, where it has none), as watermarks ask for."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def daily_acceptance(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(day, n, r2) of ``stream(ts, y_true, y_pred)`` by event day; later rows than ``late`` are closed out."""
    days = timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"))
    return days.agg(F.count("*").alias("n"), r2(T(), P()).alias("r2"))


def alarm_counts(stream: DataFrame, threshold: float, ts: str = "ts", width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of agreeing and differing alarms over sliding event windows."""
    t, p = T() >= threshold, P() >= threshold
    w = timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("window"))
    return w.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
