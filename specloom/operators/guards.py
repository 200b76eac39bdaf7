"""Bounds, classes and acceptance of single predictions, as native columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WaterParam:
    """A water parameter: class boundaries and limits."""

    name: str
    ranges: tuple[float, ...]
    lower_bound: float | None = None
    review_upper: float | None = None
    abs_error_bound: float = 0.0
    mape_bound: float = 0.15
    unit: str = "mg/L"
    standard: str = ""
    auto_device_upper: float | None = None
    river_upper: float | None = None

    def theoretical_upper(self, auto_device: float | None = None) -> float | None:
        """The lesser of the device's and the river's upper limit, of those known."""
        device = self.auto_device_upper if self.auto_device_upper is not None else auto_device
        river = self.river_upper if self.river_upper is not None else (2 * max(self.ranges) if self.ranges else None)
        known = [v for v in (device, river) if v is not None]
        return min(known) if known else None


# Class boundaries and limits of the surface-water parameters.
WATER_PARAMS = {
    p.name: p
    for p in (
        WaterParam("CODMn", (2, 4, 6, 10, 15), 0.5, 22.5, 1, 0.15),
        WaterParam("COD", (15, 15, 20, 30, 40), 4, 60, 4, 0.15),
        WaterParam("TN", (0.2, 0.5, 1, 1.5, 2), 0.05, 3, 0.1, 0.3, river_upper=10),
        WaterParam("TP", (0.02, 0.1, 0.2, 0.3, 0.4), 0.01, 0.6, 0.02, 0.15),
        WaterParam("AN", (0.15, 0.5, 1, 1.5, 2), 0.025, 3, 0.2, 0.15),
        WaterParam("TUR", (30, 50, 1000), 0.3, 150, 5, 0.15, unit="NTU"),
    )
}


def _number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def bounds(value: Column, lower: float | None, review: float | None, theoretical: float | None) -> dict[str, Column]:
    """value, below, above, over: half the lower bound below it, no value over the theoretical one."""
    ok = _number(value)
    flag = lambda test: F.coalesce(ok & test, F.lit(False))
    below = flag(value < lower) if lower is not None else F.lit(False)
    over = flag(value > theoretical) if theoretical is not None else F.lit(False)
    above = flag(value > review) & ~over if review is not None else F.lit(False)
    out = F.when(below, F.lit(lower / 2 if lower is not None else None).cast("double")).when(over, F.lit(None).cast("double")).otherwise(value)
    return {"value": out, "below": below, "above": above, "over": over}


def water_class(value: Column, ranges: tuple[float, ...]) -> Column:
    """How many boundaries the value reaches; NaN reaches all, as sorted last."""
    return reduce(lambda a, b: a + b, [F.when(value >= F.lit(float(r)), 1).otherwise(0) for r in ranges], F.lit(0)).cast("int")


def acceptable(truth: Column, pred: Column, param: WaterParam) -> Column:
    """Whether a prediction passes: by class for low truths, else by relative or absolute error."""
    r = [float(v) for v in param.ranges]
    error = F.abs(pred - truth)
    relative = error / F.greatest(F.abs(truth), F.lit(1e-12))
    absolute = error <= float(param.abs_error_bound)
    rule = None
    if len(r) >= 2:
        rule = F.when((truth <= r[1]) & (pred <= r[1]), True).when(truth <= r[1], relative <= 0.4)
        if len(r) >= 4:
            rule = rule.when((truth > r[1]) & (truth <= r[3]), relative <= 0.3)
    high = truth > r[-1] if r else F.lit(False)
    rule = rule.when(high, relative <= 0.2) if rule is not None else F.when(high, relative <= 0.2)
    return F.coalesce(rule.otherwise(absolute), F.lit(False))


def detection_limit(value: Column, limit: float) -> Column:
    """At or below the limit: half of it."""
    positive(limit)
    return F.when(_number(value) & (value <= limit), limit / 2).otherwise(value)


def range_limit(value: Column, limit: float) -> Column:
    positive(limit)
    return F.when(_number(value) & (value > limit), F.lit(float(limit))).otherwise(value)


def positive(limit: float) -> None:
    if not limit > 0:
        raise ValueError("a limit must be positive")


def glm_family(mean: Column, variance: Column) -> Column:
    """The family that a target's dispersion suggests."""
    ratio = variance / mean
    return F.when(mean <= 0, "gamma").when(ratio > 1.2, "gamma").when(ratio < 0.8, "tweedie").otherwise("poisson")
