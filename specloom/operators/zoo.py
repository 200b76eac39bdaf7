"""Model registry: linear and latent models from Grams, the rest as estimators.

Kernel and iterative models work on the calibration set, which is a few hundred
reference measurements by nature; it is fetched with a checked bound. Trees are
the library's distributed ones and are fitted on the table itself; generalised
linear models can be (``fit_frame``), as their steps need cross products only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import linear

#: Calibration samples that a non-linear model may fetch to the driver.
MAX_CALIBRATION = 20_000


class Registry:
    """Names to objects with metadata; a name is given once."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, key: str, **meta):
        def put(item):
            if key in self._items:
                raise KeyError(f"{self.kind} {key!r} exists")
            self._items[key] = (item, meta)
            return item

        return put

    def get(self, key: str):
        if key not in self._items:
            raise KeyError(f"no {self.kind} {key!r}; known: {', '.join(sorted(self._items))}")
        return self._items[key][0]

    def build(self, key: str, **params):
        return self.get(key)(**params)

    def meta(self, key: str) -> dict:
        self.get(key)
        return dict(self._items[key][1])

    def keys(self, **match) -> list[str]:
        return sorted(k for k, (_, m) in self._items.items() if all(m.get(a) == b for a, b in match.items()))

    def families(self) -> list[str]:
        return sorted({m.get("family", "") for _, m in self._items.values()})

    def items(self):
        return dict(self._items)


MODELS = Registry("model")


class Estimator:
    """fit(X, y) and predict(X) on arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Estimator:
        raise NotImplementedError

    def predict(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class FromGram(Estimator):
    """A linear model of a Gram solver."""

    solver: str
    params: dict

    def fit_gram(self, centred) -> FromGram:
        self.coef_ = linear.SOLVERS[self.solver](centred, **self.params)
        self.intercept_ = centred.mean_y - float(centred.mean_x @ self.coef_)
        return self

    def fit(self, x, y):
        from .gram import Gram

        return self.fit_gram(Gram.of(np.asarray(x, float), np.asarray(y, float)).centred())

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


for _name in linear.SOLVERS:
    MODELS.register(_name, family="latent" if _name in linear.LATENT else "linear")(lambda _s=_name, **params: FromGram(_s, params))


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, s = x.mean(0), x.std(0)
    return (x - m) / np.where(s > 0, s, 1), m, np.where(s > 0, s, 1)


@dataclass
class Reweighted(Estimator):
    """Linear fit by iteratively reweighted least squares, shared by the robust losses."""

    alpha: float = 1e-4
    rounds: int = 100

    def weights(self, r: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def fit(self, x, y):
        z, self.m, self.s = _standard(np.asarray(x, float))
        a = np.column_stack([np.ones(len(z)), z])
        penalty = self.alpha * np.eye(a.shape[1])
        penalty[0, 0] = 0
        b = np.zeros(a.shape[1])
        b[0] = np.median(y)
        for _ in range(self.rounds):
            w = self.weights(y - a @ b)
            new = np.linalg.solve(a.T @ (w[:, None] * a) + penalty + 1e-10 * np.eye(len(b)), a.T @ (w * y))
            if np.abs(new - b).max() < 1e-9:
                break
            b = new
        self.coef_ = b[1:] / self.s
        self.intercept_ = float(b[0] - self.m @ self.coef_)
        return self

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


@MODELS.register("huber", family="linear")
@dataclass
class Huber(Reweighted):
    """Huber's loss with its own scale: sum of scale + H(r / scale) scale, and alpha times the squared coefficients.

    Coefficients and scale are set in turn, each to the exact minimum for fixed weights.
    """

    epsilon: float = 1.35
    rounds: int = 500

    def fit(self, x, y):
        z, self.m, self.s = _standard(np.asarray(x, float))
        y = np.asarray(y, float)
        a = np.column_stack([np.ones(len(z)), z])
        # Centred and scaled for the solver only: the penalty is on coefficients of columns as given.
        penalty = self.alpha * np.diag(np.concatenate([[0.0], 1 / self.s**2]))
        b = np.zeros(a.shape[1])
        b[0] = np.median(y)
        scale = max(float(np.std(y)), 1e-9)
        for _ in range(self.rounds):
            r = np.abs(y - a @ b)
            near = r <= self.epsilon * scale
            free = len(y) - self.epsilon**2 * np.count_nonzero(~near)
            if free > 0:
                scale = max(float(np.sqrt((r[near] ** 2).sum() / free)), 1e-9)
            w = np.minimum(1, self.epsilon * scale / np.maximum(r, 1e-300))
            new = np.linalg.solve(a.T @ (w[:, None] * a) + scale * penalty + 1e-12 * np.eye(len(b)), a.T @ (w * y))
            done = np.abs(new - b).max() < 1e-10
            b = new
            if done:
                break
        self.scale_ = scale
        self.coef_ = b[1:] / self.s
        self.intercept_ = float(b[0] - self.m @ self.coef_)
        return self


@MODELS.register("quantile", family="linear")
@dataclass
class Quantile(Reweighted):
    quantile: float = 0.5

    def weights(self, r):
        side = np.where(r >= 0, self.quantile, 1 - self.quantile)
        return side / np.maximum(np.abs(r), 1e-6)


@MODELS.register("theilsen", family="linear")
@dataclass
class TheilSen(Estimator):
    """Spatial median of fits on seeded random subsets."""

    subsets: int = 200
    seed: int = 0

    def fit(self, x, y):
        x, y, rng = np.asarray(x, float), np.asarray(y, float), np.random.default_rng(self.seed)
        size = min(len(x), x.shape[1] + 1)
        fits = []
        for _ in range(self.subsets):
            k = rng.choice(len(x), size, replace=False)
            fits.append(np.linalg.lstsq(np.column_stack([np.ones(size), x[k]]), y[k], rcond=1e-8)[0])
        f = np.array(fits)
        b = np.median(f, axis=0)
        for _ in range(100):
            w = 1 / np.maximum(np.linalg.norm(f - b, axis=1), 1e-9)
            b = (w[:, None] * f).sum(0) / w.sum()
        self.intercept_, self.coef_ = float(b[0]), b[1:]
        return self

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


@MODELS.register("sgd", family="linear")
@dataclass
class Sgd(Estimator):
    alpha: float = 1e-4
    rate: float = 0.01
    epochs: int = 200
    seed: int = 0

    def fit(self, x, y):
        z, m, s = _standard(np.asarray(x, float))
        y, rng = np.asarray(y, float), np.random.default_rng(self.seed)
        b, c, t, step = np.zeros(z.shape[1]), float(np.mean(y)), 1.0, self.rate / max(1.0, z.shape[1] / 4)
        for _ in range(self.epochs):
            for i in rng.permutation(len(z)):
                e = z[i] @ b + c - y[i]
                eta = step / t**0.25
                b -= eta * (e * z[i] + self.alpha * b)
                c -= eta * e
                t += 1
        self.coef_ = b / s
        self.intercept_ = c - float(m @ self.coef_)
        return self

    def predict(self, x):
        return np.asarray(x, float) @ self.coef_ + self.intercept_


@dataclass
class Glm(Estimator):
    """Penalised Newton steps for a mean exp(eta) or, with an identity link, eta.

    The penalty is on coefficients of the columns as given; they are scaled for the solver only.
    """

    power: float = 1.0
    identity: bool = False
    alpha: float = 1.0
    rounds: int = 100

    def weighted(self, b: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """x and y to rows of [1, z, target] at ``b``, by the root of their weights: their cross products are a Newton step's system.

        What is returned holds arrays and numbers only, so workers need not import this package for it.
        """
        m, s, power, identity = self.m, self.s, self.power, self.identity

        def rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = np.column_stack([np.ones(len(x)), (x - m) / s])
            eta = a @ b
            mu = eta if identity else np.exp(np.clip(eta, -30, 30))
            slope = np.ones_like(mu) if identity else mu
            w = slope**2 / np.maximum(np.abs(mu) ** power, 1e-12)
            return np.sqrt(w)[:, None] * np.column_stack([a, eta + (y - mu) / slope])

        return rows

    def _newton(self, n: float, mean_y: float, cross: Callable[[np.ndarray], np.ndarray]) -> Glm:
        penalty = self.alpha * n * np.diag(np.concatenate([[0.0], 1 / self.s**2]))
        b = np.zeros(len(self.s) + 1)
        b[0] = mean_y if self.identity else np.log(max(mean_y, 1e-9))
        for _ in range(self.rounds):
            m = cross(b)
            new = np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1])
            done = np.abs(new - b).max() < 1e-9
            b = new
            if done:
                break
        self.b = b
        self.coef_ = b[1:] / self.s
        return self

    def fit(self, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        _, self.m, self.s = _standard(x)

        def cross(b: np.ndarray) -> np.ndarray:
            z = self.weighted(b)(x, y)
            return z.T @ z

        return self._newton(len(x), y.mean(), cross)

    def fit_frame(self, df: DataFrame) -> Glm:
        """The same of a table (x, y) of any length: one scan for the scales, one for each Newton step, rows without x or a finite y go."""
        from .gram import gram, long_stats

        rows = df.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")) & (F.size("x") > 0))
        n, mean = rows.agg(F.count("*"), F.avg("y")).first()
        if not n:
            raise ValueError("no rows to fit on")
        stats = long_stats(rows).orderBy("j").collect()
        self.m, sd = np.array([r["mean"] for r in stats], float), np.array([r["sd_pop"] for r in stats], float)
        if any(r["n"] != n for r in stats) or np.isnan(self.m).any():
            raise ValueError(f"spectra of {len(stats)} channels, each with a value, expected")
        self.s = np.where(sd > 0, sd, 1)
        return self._newton(n, mean, lambda b: gram(rows, design=self.weighted(b)).m)

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """``df`` with the prediction for its x, a native expression."""
        eta = arrays.dot(F.col("x"), arrays.literal(self.coef_)) + float(self.b[0] - self.m @ self.coef_)
        return df.withColumn(out, eta if self.identity else F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))

    def predict(self, x):
        eta = (np.asarray(x, float) - self.m) / self.s @ self.b[1:] + self.b[0]
        return eta if self.identity else np.exp(np.clip(eta, -30, 30))


MODELS.register("poisson", family="glm")(lambda **k: Glm(**{"power": 1.0, **k}))
MODELS.register("gamma", family="glm")(lambda **k: Glm(**{"power": 2.0, **k}))
MODELS.register("tweedie", family="glm")(lambda **k: Glm(**{"power": 0.0, "identity": True, **k}))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


@MODELS.register("krr", family="kernel")
@dataclass
class KernelRidge(Estimator):
    alpha: float = 1.0
    kernel: str = "linear"
    gamma: float | None = None

    def k(self, a, b):
        return a @ b.T if self.kernel == "linear" else np.exp(-(self.gamma or 1 / a.shape[1]) * _distances(a, b))

    def fit(self, x, y):
        self.x = np.asarray(x, float)
        self.dual = np.linalg.solve(self.k(self.x, self.x) + self.alpha * np.eye(len(self.x)), y)
        return self

    def predict(self, x):
        return self.k(np.asarray(x, float), self.x) @ self.dual


@MODELS.register("gpr", family="kernel")
@dataclass
class Gaussian(Estimator):
    """Rational quadratic kernel with noise; length and noise by likelihood on a grid, then refined."""

    rounds: int = 3

    def k(self, a, b, length, mix):
        return (1 + _distances(a, b) / (2 * mix * length**2)) ** -mix

    def _likelihood(self, length, noise, y):
        k = self.k(self.x, self.x, length, 1.0) + noise * np.eye(len(y))
        try:
            low = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return -np.inf, None
        dual = np.linalg.solve(low.T, np.linalg.solve(low, y))
        return -0.5 * y @ dual - np.log(np.diag(low)).sum(), dual

    def fit(self, x, y):
        self.x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean, self.sd = y.mean(), y.std() or 1.0
        z = (y - self.mean) / self.sd
        middle = np.sqrt(np.median(_distances(self.x, self.x))) or 1.0
        best, span = (0.0, np.log(0.1)), 2.0
        for _ in range(self.rounds):
            grid = [(best[0] + a * span, best[1] + b * span) for a in (-1, -0.5, 0, 0.5, 1) for b in (-1, -0.5, 0, 0.5, 1)]
            best = max(grid, key=lambda g: self._likelihood(middle * np.exp(g[0]), np.exp(g[1]), z)[0])
            span /= 2
        self.length = middle * np.exp(best[0])
        self.dual = self._likelihood(self.length, np.exp(best[1]), z)[1]
        return self

    def predict(self, x):
        return self.mean + self.sd * self.k(np.asarray(x, float), self.x, self.length, 1.0) @ self.dual


@MODELS.register("svr", family="kernel")
@dataclass
class SupportVector(Estimator):
    """Epsilon-insensitive regression: projected coordinate ascent on the dual differences."""

    c: float = 1.0
    epsilon: float = 0.1
    gamma: float | None = None
    rounds: int = 300

    def fit(self, x, y):
        self.x, y = np.asarray(x, float), np.asarray(y, float)
        self.g = self.gamma or 1 / (self.x.shape[1] * max(self.x.var(), 1e-12))
        k = np.exp(-self.g * _distances(self.x, self.x)) + 1.0  # the constant stands for the intercept
        b, f = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(self.rounds):
            moved = 0.0
            for i in range(len(y)):
                r = y[i] - f[i] + k[i, i] * b[i]
                new = float(np.clip(np.sign(r) * max(abs(r) - self.epsilon, 0) / k[i, i], -self.c, self.c))
                if new != b[i]:
                    f += k[i] * (new - b[i])
                    moved, b[i] = max(moved, abs(new - b[i])), new
            if moved < 1e-5:
                break
        self.dual = b
        return self

    def predict(self, x):
        return (np.exp(-self.g * _distances(np.asarray(x, float), self.x)) + 1.0) @ self.dual


@MODELS.register("mlp", family="nn")
@dataclass
class Mlp(Estimator):
    hidden: int = 100
    alpha: float = 1e-4
    rate: float = 1e-3
    epochs: int = 300
    seed: int = 0

    def fit(self, x, y):
        z, self.m, self.s = _standard(np.asarray(x, float))
        y = np.asarray(y, float)
        self.my, self.sy = y.mean(), y.std() or 1.0
        t, rng = (y - self.my) / self.sy, np.random.default_rng(self.seed)
        w = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, np.sqrt(1 / self.hidden), self.hidden), np.zeros(1)]
        m, v, k = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(self.epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 200):
                b = order[i : i + 200]
                h = np.maximum(z[b] @ w[0] + w[1], 0)
                d = (h @ w[2] + w[3][0] - t[b]) / len(b)
                dh = np.outer(d, w[2]) * (h > 0)
                grads = [z[b].T @ dh + self.alpha * w[0] / len(z), dh.sum(0), h.T @ d + self.alpha * w[2] / len(z), np.array([d.sum()])]
                k += 1
                for a, g, mm, vv in zip(w, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= self.rate * (mm / (1 - 0.9**k)) / (np.sqrt(vv / (1 - 0.999**k)) + 1e-8)
        self.w = w
        return self

    def predict(self, x):
        z = (np.asarray(x, float) - self.m) / self.s
        return self.my + self.sy * (np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0])


@MODELS.register("gam", family="gam")
@dataclass
class Additive(Estimator):
    """Cubic B-splines of every channel with a ridge penalty."""

    n_knots: int = 8
    degree: int = 3
    smooth: float = 1.0

    def basis(self, x):
        blocks = []
        for j in range(x.shape[1]):
            t, v = self.knots[j], np.clip(x[:, j], self.knots[j][self.degree], self.knots[j][-self.degree - 1] - 1e-9)
            b = ((t[None, :-1] <= v[:, None]) & (v[:, None] < t[None, 1:])).astype(float)
            for d in range(1, self.degree + 1):
                left, right = t[d:-1] - t[: -d - 1], t[d + 1 :] - t[1:-d]
                a = np.divide(v[:, None] - t[None, : -d - 1], left, where=left > 0, out=np.zeros((len(v), len(left))))
                c = np.divide(t[None, d + 1 :] - v[:, None], right, where=right > 0, out=np.zeros((len(v), len(right))))
                b = a * b[:, :-1] + c * b[:, 1:]
            blocks.append(b)
        return np.concatenate(blocks, axis=1)

    def fit(self, x, y):
        x = np.asarray(x, float)
        self.knots = []
        for j in range(x.shape[1]):
            low, high = x[:, j].min(), x[:, j].max()
            step = max(high - low, 1e-9) / (self.n_knots - 1)
            self.knots.append(low + step * np.arange(-self.degree, self.n_knots + self.degree))
        b = self.basis(x)
        self.mean = b.mean(0)
        b = b - self.mean
        self.offset = float(np.mean(y))
        self.weights = np.linalg.solve(b.T @ b + self.smooth * np.eye(b.shape[1]), b.T @ (np.asarray(y, float) - self.offset))
        return self

    def predict(self, x):
        return self.offset + (self.basis(np.asarray(x, float)) - self.mean) @ self.weights


class Trees(Estimator):
    """A distributed tree ensemble behind the array interface."""

    def __init__(self, kind: str, **params):
        self.kind, self.params = kind, params

    def fit_frame(self, df: DataFrame) -> Trees:
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        make = {"rf": RandomForestRegressor, "lgbm": GBTRegressor}[self.kind]
        defaults = {"rf": {"numTrees": 100, "maxDepth": 10}, "lgbm": {"maxIter": 50, "maxDepth": 5}}[self.kind]
        rows = df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
        self.model = make(seed=0, **{**defaults, **self.params}).fit(rows)
        return self

    def load(self, path: str) -> Trees:
        from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel

        self.model = {"rf": RandomForestRegressionModel, "lgbm": GBTRegressionModel}[self.kind].load(path)
        return self

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        rows = self.model.setPredictionCol(out).transform(df.withColumn("features", array_to_vector("x")))
        return rows.drop("features")

    def fit(self, x, y):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        return self.fit_frame(spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double"))

    def predict(self, x):
        from pyspark.ml.linalg import Vectors

        return np.array([self.model.predict(Vectors.dense(v)) for v in np.asarray(x, float)])


MODELS.register("rf", family="trees")(lambda **k: Trees("rf", **k))
MODELS.register("lgbm", family="trees")(lambda **k: Trees("lgbm", **k))


def build_model(key: str, **params) -> Estimator:
    return MODELS.build(key, **params)


def calibration(df: DataFrame, bound: int = MAX_CALIBRATION) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a calibration set, on the driver; a larger one is refused, not cut."""
    rows = df.select("x", "y").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} calibration samples: use a Gram model or trees")
    return np.array([r.x for r in rows], float), np.array([r.y for r in rows], float)
