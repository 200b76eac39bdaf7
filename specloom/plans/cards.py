"""Model cards: a fitted chain, a model and its provenance, as one JSON row."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import zoo
from ..operators.preprocess import Fitted


@dataclass
class ModelCard:
    """All that serving needs; linear models carry coefficients on preprocessed spectra."""

    model_key: str
    label: str
    chain: list[dict]
    state: dict
    axis: list[float]
    coef: list[float] | None
    intercept: float
    params: dict = field(default_factory=dict)
    fom: dict = field(default_factory=dict)
    lower_bound: float | None = None
    review_upper: float | None = None
    theoretical_upper: float | None = None
    instrument_id: str | None = None
    data_hash: str = ""
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    version: str = "1"
    estimator: object = field(default=None, repr=False, compare=False)

    def fingerprint(self) -> str:
        """16 hex digits of the model key, canonical chain, axis and version."""
        body = {"model_key": self.model_key, "chain": self.chain, "axis": [round(v, 6) for v in self.axis], "version": self.version}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]

    @property
    def model_type(self) -> str:
        """Unique also among cards that differ in label or parameters only."""
        extra = hashlib.sha256(json.dumps([self.label, self.params], sort_keys=True).encode()).hexdigest()[:6]
        return f"{self.model_key}::{self.fingerprint()}::{extra}"

    def fitted(self) -> Fitted:
        return Fitted(**self.state)

    def describe(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k not in ("state", "coef", "axis", "estimator")}
        return out | {"fingerprint": self.fingerprint(), "n_wavelengths": len(self.axis)}

    def to_json(self) -> str:
        """The card as JSON; an estimator's arrays are part of it, but not a tree ensemble (see ``save_cards``)."""
        body = {k: v for k, v in self.__dict__.items() if k != "estimator"}
        if self.estimator is not None:
            body["estimator"] = _plain(self.estimator)
        return json.dumps(body | {"fingerprint": self.fingerprint()})

    @staticmethod
    def from_json(text: str) -> ModelCard:
        body = json.loads(text)
        stored = body.pop("fingerprint")
        body["estimator"] = _rebuilt(body.get("estimator"))
        card = ModelCard(**body)
        if card.fingerprint() != stored:
            raise ValueError("the stored fingerprint differs from the card's content")
        return card


def _plain(value):
    """JSON for an estimator: arrays and objects are tagged, Spark's own models left out."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": str(value.dtype)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {"dict": {k: _plain(v) for k, v in value.items()}}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, (zoo.Estimator, Wrapped)):
        return {"object": type(value).__name__, "state": {k: _plain(v) for k, v in value.__dict__.items() if not _of_spark(v)}}
    raise TypeError(f"{type(value).__name__} can't be stored")


def _of_spark(value) -> bool:
    return type(value).__module__.startswith("pyspark.")


def _rebuilt(value):
    if isinstance(value, list):
        return [_rebuilt(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "array" in value:
        return np.array(value["array"], value["type"])
    if "dict" in value:
        return {k: _rebuilt(v) for k, v in value["dict"].items()}
    kind = Wrapped if value["object"] == Wrapped.__name__ else getattr(zoo, value["object"])
    out = kind.__new__(kind)
    out.__dict__.update({k: _rebuilt(v) for k, v in value["state"].items()})
    return out


class Wrapped:
    """An estimator on centred spectra and a z-scored target, inverted on prediction."""

    def __init__(self, inner, key: str):
        self.inner, self.raw = inner, key in ("poisson", "gamma") or isinstance(inner, zoo.Trees)
        self.mx, self.my, self.sy = 0.0, 0.0, 1.0

    def fit(self, x, y):
        if not self.raw:
            self.mx, self.my, self.sy = x.mean(0), float(y.mean()), float(y.std()) or 1.0
        self.inner.fit(x - self.mx, (y - self.my) / self.sy)
        return self

    def predict(self, x):
        return self.inner.predict(np.asarray(x, float) - self.mx) * self.sy + self.my


def _ensemble(card: ModelCard):
    inner = getattr(card.estimator, "inner", None)
    return inner if isinstance(inner, zoo.Trees) else None


def save_cards(spark: SparkSession, cards: list[ModelCard], path: str, mode: str = "errorifexists") -> None:
    """``path``/cards as one table; tree ensembles beside it, by Spark ML's own writer."""
    rows = [(c.model_type, c.label, c.to_json(), json.dumps(c.describe(), default=str)) for c in cards]
    spark.createDataFrame(rows, "model_type string, label string, card string, description string").coalesce(1).write.mode(mode).parquet(f"{path}/cards")
    for c in cards:
        if trees := _ensemble(c):
            trees.model.write().overwrite().save(f"{path}/trees/{_folder(c)}")


def _folder(card: ModelCard) -> str:
    return hashlib.sha256(card.model_type.encode()).hexdigest()[:16]


def load_cards(spark: SparkSession, path: str) -> list[ModelCard]:
    cards = [ModelCard.from_json(r.card) for r in spark.read.parquet(f"{path}/cards").orderBy("model_type").collect()]
    for c in cards:
        if trees := _ensemble(c):
            trees.load(f"{path}/trees/{_folder(c)}")
    return cards


def data_fingerprint(df: DataFrame) -> str:
    """Order-free digest of spectra and targets: row hashes, summed exactly."""
    columns = [c for c in ("x", "y") if c in df.columns]
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    r = df.agg(F.sum(h), F.count("*")).first()
    return hashlib.sha256(f"{r[0]}:{r[1]}".encode()).hexdigest()[:16]


def max_difference(a: np.ndarray, b: np.ndarray) -> float:
    both = np.isfinite(a) & np.isfinite(b)
    return float(np.abs(a[both] - b[both]).max(initial=0))
