"""Calibration: cross-validation, training, sweeps and candidate scoring.

Linear models read the data once per chain: one Gram per fold gives every
model, component count and error, test errors included (a quadratic form of
the fold's Gram). Other models fetch the bounded calibration set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, literal
from ..operators import linear, scoring
from ..operators.gram import Gram, grams
from ..operators.guards import WaterParam
from ..operators.preprocess import fit as fit_chain
from ..operators.selection import quadratic_rmse
from ..operators.sequences import day_folds, kfold
from ..operators.zoo import MODELS, Trees, build_model, calibration
from .cards import ModelCard, Wrapped, data_fingerprint


def assign_folds(df: DataFrame, folds: int = 5, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """``fold`` by a seeded hash of the key: no ordering, no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(folds)))


def split_grams(df: DataFrame, cv: str = "kfold", folds: int = 5, seed: int = 0, window: int | None = None) -> list[tuple[Gram, Gram]]:
    """(train, test) Grams of each split, from one Gram per fold or day."""
    if cv == "kfold":
        own = grams(assign_folds(df, folds, seed), "fold")
        total = reduce(lambda a, b: a + b, own.values())
        return [(total - g, g) for g in own.values()] if len(own) > 1 else []
    own = grams(df, "day_idx")
    roles = day_folds(df.select("day_idx"), cv, window).collect()
    out = []
    for fold in sorted({r.fold for r in roles}):
        days = lambda role: [own[r.day_idx] for r in roles if r.fold == fold and r.role == role]  # noqa: B023, E731
        out.append((reduce(lambda a, b: a + b, days("train")), reduce(lambda a, b: a + b, days("test"))))
    if not out:
        raise ValueError(f"{cv} has no split: too few days for the window")
    return out


def solve(key: str, train: Gram, params: dict) -> tuple[np.ndarray, float]:
    """Coefficients and intercept with y z-scored around the solver, as calibrations are."""
    c = train.centred()
    sd = np.sqrt(c.yy / c.n) or 1.0
    scaled = type(c)(c.n, c.mean_x, 0.0, c.xx, c.xy / sd, c.yy / sd**2)
    b = linear.SOLVERS[key](scaled, **params) * sd
    return b, c.mean_y - float(c.mean_x @ b)


def cv_rmse(splits: list[tuple[Gram, Gram]], key: str, params: dict) -> float:
    """Mean over splits of the test error."""
    return float(np.mean([quadratic_rmse(test, *solve(key, train, params)) for train, test in splits]))


def select_n_components(splits: list[tuple[Gram, Gram]], key: str = "pls", max_components: int = 20, params: dict | None = None) -> int:
    top = min(max_components, *(int(t.n) - 1 for t, _ in splits), len(splits[0][0].m) - 2)
    params = {k: v for k, v in (params or {}).items() if k != "n_components"}
    return 1 + int(np.nanargmin([cv_rmse(splits, key, {**params, "n_components": k}) for k in range(1, max(top, 1) + 1)]))


def rows_cv(x: np.ndarray, y: np.ndarray, key: str, params: dict, folds: int, seed: int) -> float:
    """The same for models without a Gram."""
    out = []
    for test in kfold(len(y), folds, seed):
        train = np.setdiff1d(np.arange(len(y)), test)
        m, s = y[train].mean(), y[train].std() or 1.0
        raw_y = key in ("poisson", "gamma")
        target = y[train] if raw_y else (y[train] - m) / s
        pred = build_model(key, **params).fit(x[train] - (0 if raw_y else x[train].mean(0)), target).predict(x[test] - (0 if raw_y else x[train].mean(0)))
        out.append(np.sqrt(np.mean(((pred if raw_y else pred * s + m) - y[test]) ** 2)))
    return float(np.mean(out))


def frame_rmse(model: Trees, df: DataFrame) -> float:
    e = F.col("pred") - F.col("y")
    return float(model.transform(df, "pred").agg(F.sqrt(F.avg(e * e))).first()[0])


def trees_cv(df: DataFrame, key: str, params: dict, folds: int, seed: int) -> float:
    """The same for trees, on tables: folds by the key's hash."""
    dealt = assign_folds(df, folds, seed)
    errors = [frame_rmse(build_model(key, **params).fit_frame(dealt.where(F.col("fold") != f)), own) for f in range(folds) if not (own := dealt.where(F.col("fold") == f)).isEmpty()]
    return float(np.mean(errors))


def train_model(df: DataFrame, axis: list[float], label: str, model_key: str = "pls", chain: list[dict] = (), model_params: dict | None = None, param: WaterParam | None = None, folds: int = 5, cv: str = "kfold", cv_window: int | None = None, seed: int = 0, instrument_id: str | None = None, calibration_upper: float | None = None) -> ModelCard:
    """A card of ``df(sample_id, x, y[, day_idx])``: rows without a finite y go, the chain is fitted on the rest."""
    df = df.where(F.col("y").isNotNull() & ~F.isnan("y"))
    fitted = fit_chain(list(chain), df, len(axis))
    ready = fitted.transform(df)
    return _train(ready, df, fitted, axis, label, model_key, dict(model_params or {}), param, folds, cv, cv_window, seed, instrument_id, calibration_upper)


def _train(ready, df, fitted, axis, label, key, params, param, folds, cv, cv_window, seed, instrument_id, upper, splits=None) -> ModelCard:
    MODELS.get(key)
    estimator = coef = None
    intercept = 0.0
    if key in linear.SOLVERS:
        splits = splits if splits is not None else split_grams(ready, cv, folds, seed, cv_window)
        whole = splits[0][0] + splits[0][1] if cv in ("kfold", "logo") else reduce(lambda a, b: a + b, grams(ready, "day_idx").values())
        if key in linear.LATENT and "n_components" not in params:
            params["n_components"] = select_n_components(splits, key, params=params)
        coef, intercept = solve(key, whole, params)
        rmse_cv, rmse_fit = cv_rmse(splits, key, params), quadratic_rmse(whole, coef, intercept)
    elif isinstance(model := build_model(key, **params), Trees):
        estimator = Wrapped(model.fit_frame(ready), key)
        rmse_cv, rmse_fit = trees_cv(ready, key, params, folds, seed), frame_rmse(model, ready)
    else:
        x, y = calibration(ready)
        rmse_cv = rows_cv(x, y, key, params, folds, seed)
        estimator = Wrapped(model, key).fit(x, y)
        rmse_fit = float(np.sqrt(np.mean((estimator.predict(x) - y) ** 2)))
    theoretical = param.theoretical_upper(upper) if param else upper
    return ModelCard(key, label, fitted.steps, {"steps": fitted.steps, "p": fitted.p, "state": fitted.state}, list(map(float, axis)), None if coef is None else coef.tolist(), float(intercept), params, {"rmse_cv": rmse_cv, "rmse_fit": rmse_fit}, param.lower_bound if param else None, param.review_upper if param else None, theoretical, instrument_id, data_fingerprint(df), estimator=estimator)


def sweep(df: DataFrame, axis: list[float], label: str, model_keys=("pls", "ridge", "lasso", "ols"), chain=(), **options) -> list[ModelCard]:
    """Cards of several models on one chain, by cross-validated error."""
    cards = sweep_grid(df, axis, label, model_keys, [chain], **options)
    return sorted(cards, key=lambda c: (not np.isfinite(c.fom["rmse_cv"]), c.fom["rmse_cv"]))


def sweep_grid(df: DataFrame, axis: list[float], label: str, model_keys, chains, model_params: dict | None = None, param: WaterParam | None = None, folds: int = 5, cv: str = "kfold", cv_window: int | None = None, seed: int = 0, instrument_id: str | None = None, calibration_upper: float | None = None) -> list[ModelCard]:
    """Every model on every chain; each chain's Grams are computed once and shared."""
    df = df.where(F.col("y").isNotNull() & ~F.isnan("y"))
    cards = []
    for chain in chains:
        fitted = fit_chain(list(chain), df, len(axis))
        ready = fitted.transform(df)
        splits = split_grams(ready, cv, folds, seed, cv_window) if any(k in linear.SOLVERS for k in model_keys) else None
        for key in model_keys:
            cards.append(_train(ready, df, fitted, axis, label, key, dict((model_params or {}).get(key, {})), param, folds, cv, cv_window, seed, instrument_id, calibration_upper, splits))
    return cards


def raw_predictions(card: ModelCard, df: DataFrame, out: str = "y_pred") -> DataFrame:
    """``df`` with unbounded predictions of the card."""
    keep = df.withColumn("__x", F.col("x"))
    ready = card.fitted().transform(keep)
    if card.coef is not None:
        ready = ready.withColumn(out, dot(F.col("x"), literal(card.coef)) + card.intercept)
    else:
        model = card.estimator
        if isinstance(model.inner, Trees):
            ready = model.inner.transform(ready, out)
        else:

            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for b in batches:
                    yield pd.Series(model.predict(np.stack(b.to_numpy())) if len(b) else [], dtype="float64")

            ready = ready.withColumn(out, F.pandas_udf(run, "double")(F.col("x")))
    return ready.withColumn("x", F.col("__x")).drop("__x")


def pool_predictions(cards: list[ModelCard], df: DataFrame, seq: str = "sample_id") -> DataFrame:
    """(model_type, seq, day_idx, y_true, y_pred) of all cards in one table."""
    day = F.col("day_idx") if "day_idx" in df.columns else F.lit(None).cast("int")
    parts = [raw_predictions(c, df).select(F.lit(c.model_type).alias("model_type"), F.col(seq).alias("seq"), day.alias("day_idx"), F.col("y").alias("y_true"), "y_pred") for c in cards]
    return reduce(DataFrame.unionByName, parts)


def score_cards(cards: list[ModelCard], df: DataFrame, param: WaterParam) -> DataFrame:
    """Ranked score rows of all cards on labelled validation spectra."""
    day = "day_idx" if "day_idx" in df.columns else None
    return scoring.rank_models(scoring.score_rows(pool_predictions(cards, df), param, day=day))


def evaluate_preprocessing(df: DataFrame, blanks: DataFrame, axis: list[float], chain, model_key: str = "pls", model_params: dict | None = None, folds: int = 5, seed: int = 0) -> dict:
    """Noise before and after a chain, and what it does to sensitivity and error."""
    from ..operators.fom import analytical_sensitivity, sensitivity, spectral_noise

    card = train_model(df, axis, "target", model_key, chain, model_params, folds=folds, seed=seed)
    before, after = spectral_noise(blanks), spectral_noise(card.fitted().transform(blanks))
    out = {"s_x_before": before, "s_x_after": after, "rmse_fit": card.fom["rmse_fit"], "rmse_cv": card.fom["rmse_cv"]}
    out["overfit_gap"] = out["rmse_cv"] - out["rmse_fit"]
    if card.coef is not None:
        out |= {"sen": sensitivity(np.array(card.coef)), "gamma": analytical_sensitivity(np.array(card.coef), after)}
    return out
