"""Serving: bounded predictions, guards, fusion and compiled linear models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import dot, literal
from ..operators import guards
from ..operators.guards import WaterParam
from ..operators.preprocess import CompileError, Fitted, linear_matrix
from ..operators.spectra import ShapeError, validate
from .cards import ModelCard, max_difference
from .train import raw_predictions


def check_axis(card: ModelCard, axis: list[float] | None) -> None:
    if axis is None:
        return
    if len(axis) != len(card.axis):
        raise ShapeError(f"{len(card.axis)} channels expected, got {len(axis)}")
    if not np.allclose(axis, card.axis):
        raise ShapeError("the wavelength axis differs from the card's")


def predict(card: ModelCard, df: DataFrame, axis: list[float] | None = None, out: str = "prediction") -> DataFrame:
    """``df`` with the bounded prediction; works on batches and streams alike."""
    check_axis(card, axis)
    raw = raw_predictions(card, validate(df, card.axis), "__raw")
    b = guards.bounds(F.col("__raw"), card.lower_bound, card.review_upper, card.theoretical_upper)
    return raw.withColumn(out, b["value"]).drop("__raw")


def predict_with_guard(card: ModelCard, df: DataFrame, param: WaterParam | None = None) -> DataFrame:
    """``df`` with prediction, below_lod, above_review and not_display."""
    lower, review = (param.lower_bound, param.review_upper) if param else (card.lower_bound, card.review_upper)
    theoretical = card.theoretical_upper if card.theoretical_upper is not None else (param.theoretical_upper() if param else None)
    raw = raw_predictions(card, validate(df, card.axis), "__raw")
    b = guards.bounds(F.col("__raw"), lower, review, theoretical)
    names = {"value": "prediction", "below": "below_lod", "above": "above_review", "over": "not_display"}
    return raw.select(*df.columns, *[c.alias(names[k]) for k, c in b.items()])


def fusion_weights(rmses: list[float], scheme: str = "inv_rmse2") -> np.ndarray:
    """By inverse squared error; equal where asked, or where an error is not a positive number."""
    r = np.array(rmses, float)
    if not len(r):
        raise ValueError("nothing to fuse")
    if scheme == "equal" or not (np.isfinite(r) & (r > 0)).all():
        return np.full(len(r), 1 / len(r))
    return (1 / r**2) / (1 / r**2).sum()


def fuse(cards: list[ModelCard], df: DataFrame, scheme: str = "inv_rmse2", param: WaterParam | None = None, out: str = "fused") -> tuple[DataFrame, list[float]]:
    """Weighted predictions side by side; the bounds, if any, without a theoretical upper."""
    weights = fusion_weights([c.fom.get("rmse_cv", float("nan")) for c in cards], scheme)
    total = F.lit(0.0)
    for k, (c, w) in enumerate(zip(cards, weights)):
        df = raw_predictions(c, df, f"__p{k}")
        total = total + float(w) * F.col(f"__p{k}")
    if param:
        total = guards.bounds(total, param.lower_bound, param.review_upper, None)["value"]
    return df.withColumn(out, total).drop(*[f"__p{k}" for k in range(len(cards))]), weights.tolist()


class EdgeModel:
    """A card compiled to a few dense operations.

    Neighbouring linear steps are one matrix, centring and scaling one affine
    step; what follows the last non-linear step is folded into the coefficients,
    so a chain of linear steps alone becomes a dot product.
    """

    def __init__(self, ops: list[dict], coef: np.ndarray, intercept: float, bounds: list):
        self.ops, self.coef, self.intercept, self.bounds = ops, np.asarray(coef, float), float(intercept), bounds

    @staticmethod
    def compile(card: ModelCard) -> EdgeModel:
        if card.coef is None:
            raise TypeError(f"{card.model_key} is not linear and can't be compiled")
        ops: list[dict] = []
        for step, state in zip(card.fitted().steps, card.fitted().state):
            m = linear_matrix(step, len(card.axis))
            if m is not None:
                if ops and ops[-1]["kind"] == "matmul":
                    ops[-1]["m"] = m @ ops[-1]["m"]
                else:
                    ops.append({"kind": "matmul", "m": m})
            elif step["op"] in ("mean_center", "column_scale"):
                scale = np.array(state.get("scale", np.ones(len(card.axis))))
                ops.append({"kind": "affine", "a": 1 / scale, "b": -np.array(state["mean"]) / scale})
            elif step["op"] in ("snv", "msc", "wavelet", "baseline", "wlsbaseline", "osc"):
                ops.append({"kind": "step", "step": step, "state": state})
            else:
                raise CompileError(f"{step['op']} can't be compiled")
        coef, intercept = np.array(card.coef, float), card.intercept
        while ops and ops[-1]["kind"] != "step":
            op = ops.pop()
            if op["kind"] == "matmul":
                coef = op["m"].T @ coef
            else:
                intercept, coef = intercept + float(op["b"] @ coef), op["a"] * coef
        return EdgeModel(ops, coef, intercept, [card.lower_bound, card.review_upper, card.theoretical_upper])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Raw predictions of an array."""
        from ..operators.preprocess import apply_rows

        for op in self.ops:
            if op["kind"] == "matmul":
                x = x @ op["m"].T
            elif op["kind"] == "affine":
                x = x * op["a"] + op["b"]
            else:
                x = apply_rows(x, op["step"], op["state"], x.shape[1])
        return x @ self.coef + self.intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        lower, _, upper = self.bounds
        y = self.apply(np.asarray(x, float))
        y = np.where(y < lower, lower / 2, y) if lower is not None else y
        return np.where(y > upper, np.nan, y) if upper is not None else y

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """On a table or stream; a fully folded model stays native."""
        if self.ops:
            from ..operators.preprocess import batched

            model = self
            raw = batched(df.withColumn("__y", F.col("x")), lambda x: model.apply(x)[:, None], "__y")
            raw = raw.withColumn("__y", F.col("__y")[0])
        else:
            raw = df.withColumn("__y", dot(F.col("x"), literal(self.coef)) + self.intercept)
        return raw.withColumn(out, guards.bounds(F.col("__y"), *self.bounds)["value"]).drop("__y")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        ops = [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in op.items()} for op in self.ops]
        manifest = json.dumps({"ops": ops, "intercept": self.intercept, "bounds": self.bounds})
        spark.createDataFrame([(manifest, self.coef.tolist())], "manifest string, coef array<double>").coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> EdgeModel:
        r = spark.read.parquet(path).first()
        body = json.loads(r.manifest)
        ops = [{k: np.array(v) if isinstance(v, list) else v for k, v in op.items()} for op in body["ops"]]
        return EdgeModel(ops, np.array(r.coef), body["intercept"], body["bounds"])

    def verify(self, card: ModelCard, x: np.ndarray, atol: float = 1e-8) -> float:
        """The largest difference to the card's own path; beyond ``atol`` an error."""
        chain: Fitted = card.fitted()
        gap = max_difference(self.apply(x), chain.apply(np.asarray(x, float)) @ np.array(card.coef) + card.intercept)
        if gap > atol:
            raise ValueError(f"compiled and trained predictions differ by {gap:g}")
        return gap
