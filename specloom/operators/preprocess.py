"""Row-wise preprocessing and fitted chains.

A chain is a list of ``{"op": name, **parameters}``. ``fit`` walks it once and
returns a fitted chain that carries all its state, so applying it to another
batch, a stream or one row gives the same values. Closed forms (SNV, MSC,
centring, scaling, OSC) are native expressions; linear filters become one
matrix, applied like the wavelet and baseline kernels in Arrow batches, and
neighbouring matrices are multiplied into one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.arrays import affine, bound, dot, literal, mean, moments
from .gram import column_stats, gram


class CompileError(ValueError):
    """A step that can't be planned."""


@dataclass(frozen=True)
class Spec:
    """An operation: defaults, family, and whether it needs fitting or a target."""

    name: str
    defaults: dict
    family: str
    fitted: bool = False
    target: bool = False


SPECS = {
    s.name: s
    for s in (
        Spec("savgol", {"window": 15, "polyorder": 3, "deriv": 0}, "smoothing"),
        Spec("deriv_gram", {"der": 0, "window": None, "order": 2}, "derivative"),
        Spec("wavelet", {"wavelet": "sym4", "level": 2}, "smoothing"),
        Spec("snv", {}, "scatter"),
        Spec("msc", {}, "scatter", fitted=True),
        Spec("mean_center", {}, "scaling", fitted=True),
        Spec("column_scale", {}, "scaling", fitted=True),
        Spec("osc", {"n_components": 1, "tol": 1e-6}, "orthogonal", fitted=True, target=True),
        Spec("whittaker", {"lam": 1e4, "d": 2}, "smoothing"),
        Spec("baseline", {"order": 2, "lam": 1e6, "itermax": 10, "p": 1e-3}, "baseline"),
        Spec("wlsbaseline", {"lam": 1e6, "p": 1e-3, "d": 2, "n_iter": 10}, "baseline"),
    )
}


#: Kernels of registered operations, (rows, p) to (rows, q).
KERNELS: dict[str, Callable[..., np.ndarray]] = {}


def register_op(name: str, family: str, **defaults):
    """Registers ``kernel(x, **parameters)`` over rows as an operation of chains; a name is given once."""

    def put(kernel: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
        if name in SPECS:
            raise KeyError(f"operation {name!r} exists")
        SPECS[name], KERNELS[name] = Spec(name, defaults, family), kernel
        return kernel

    return put


def list_ops(family: str | None = None) -> list[str]:
    return sorted(s.name for s in SPECS.values() if family in (None, s.family))


def canonical(chain: list[dict]) -> list[dict]:
    """The chain with every parameter given."""
    out = []
    for step in chain:
        if "op" not in step:
            raise ValueError(f"a step without op: {step}")
        if step["op"] not in SPECS:
            raise CompileError(f"unknown op {step['op']!r}")
        given = {k: v for k, v in step.items() if k != "op"}
        if unknown := set(given) - set(SPECS[step["op"]].defaults):
            raise ValueError(f"{step['op']} has no parameter {sorted(unknown)}")
        out.append({"op": step["op"], **SPECS[step["op"]].defaults, **given})
    return out


def linear_matrix(step: dict, p: int) -> np.ndarray | None:
    """The (p, p) matrix of a linear step, output by input, or None."""
    if step["op"] == "savgol":
        return kernels.smoothing_matrix(p, int(step["window"]), int(step["polyorder"]), int(step["deriv"]))
    if step["op"] == "deriv_gram":
        window = kernels.default_window(p) if step["window"] is None else int(step["window"])
        return kernels.smoothing_matrix(p, window, int(step["order"]), int(step["der"]))
    if step["op"] == "whittaker":
        return kernels.whittaker(np.eye(p), float(step["lam"]), int(step["d"])).T
    return None


def snv(x: Column) -> Column:
    """(x - mean) / sd with the population sd; a constant spectrum becomes zero."""
    m = moments(x)
    scale = F.when(m["m2"] > 0, F.sqrt(m["m2"] / m["n"])).otherwise(1.0)
    return bound(F.struct(m["mean"].alias("mean"), scale.alias("scale")), lambda s: F.transform(x, lambda v: (v - s["mean"]) / s["scale"]))


def msc(x: Column, reference: np.ndarray) -> Column:
    """(x - b) / a for the least-squares line x = a reference + b."""
    r = np.asarray(reference, float)
    centred = r - r.mean()
    ss = float(centred @ centred)
    slope = dot(x, literal(centred)) / (ss if ss > 0 else 1.0)
    slope = F.when(F.abs(slope) < 1e-12, 1e-12).otherwise(slope)
    line = F.struct(slope.alias("a"), mean(x).alias("m"))
    return bound(line, lambda f: F.transform(x, lambda v: (v - f["m"]) / f["a"] + float(r.mean())))


def batched(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = "x") -> DataFrame:
    """``kernel`` over (rows, p) batches of ``column``; all rows of a batch are of one length."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(s):
                yield s
                continue
            yield pd.Series(list(kernel(np.stack([np.asarray(v, float) for v in s]))))

    return df.withColumn(column, F.pandas_udf(run, "array<double>")(F.col(column)))


def multiply(df: DataFrame, matrix: np.ndarray, column: str = "x") -> DataFrame:
    w = np.ascontiguousarray(matrix.T)
    return batched(df, lambda x: x @ w, column)


@dataclass
class Fitted:
    """A fitted chain: for each step its parameters and state (JSON-able)."""

    steps: list[dict]
    p: int
    state: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        pending: np.ndarray | None = None
        for step, state in zip(self.steps, self.state):
            matrix = linear_matrix(step, self.p)
            if matrix is not None:
                pending = matrix if pending is None else matrix @ pending
                continue
            if pending is not None:
                df, pending = multiply(df, pending), None
            df = apply_step(df, step, state)
        return df if pending is None else multiply(df, pending)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The same on an array, for a few rows on the driver."""
        for step, state in zip(self.steps, self.state):
            x = apply_rows(x, step, state, self.p)
        return x

    def to_json(self) -> str:
        return json.dumps({"p": self.p, "steps": self.steps, "state": self.state})

    @staticmethod
    def from_json(text: str) -> Fitted:
        return Fitted(**json.loads(text))


def _deflated(p: Column) -> Callable[[Column], Column]:
    """Takes t times p out of the spectrum; t is computed once per row."""
    return lambda t: F.zip_with("x", p, lambda a, b: a - t * b)


def apply_step(df: DataFrame, step: dict, state: dict) -> DataFrame:
    op, x = step["op"], F.col("x")
    if op == "snv":
        return df.withColumn("x", snv(x))
    if op == "msc":
        return df.withColumn("x", msc(x, np.array(state["reference"])))
    if op == "mean_center":
        return df.withColumn("x", affine(x, [1.0] * len(state["mean"]), [-m for m in state["mean"]]))
    if op == "column_scale":
        return df.withColumn("x", affine(x, [1 / s for s in state["scale"]], [-m / s for m, s in zip(state["mean"], state["scale"])]))
    if op == "osc":
        df = df.withColumn("x", affine(x, [1.0] * len(state["mean"]), [-m for m in state["mean"]]))
        for w, p in zip(state["w"], state["p"]):
            t = dot(F.col("x"), literal(w))
            df = df.withColumn("x", bound(t, _deflated(literal(p))))
        return df.withColumn("x", affine(F.col("x"), [1.0] * len(state["mean"]), state["mean"]))
    if op in KERNELS:
        # The kernel travels with the task: workers have not registered it.
        kernel, given = KERNELS[op], {k: v for k, v in step.items() if k != "op"}
        return batched(df, lambda rows: kernel(rows, **given))
    return batched(df, lambda rows: apply_rows(rows, step, state, rows.shape[1]))


def apply_rows(x: np.ndarray, step: dict, state: dict, p: int) -> np.ndarray:
    op = step["op"]
    if op in KERNELS:
        return KERNELS[op](x, **{k: v for k, v in step.items() if k != "op"})
    matrix = linear_matrix(step, p)
    if matrix is not None:
        return x @ matrix.T
    if op == "wavelet":
        return kernels.wavelet_denoise(x, int(step["level"]), wavelet=step["wavelet"])
    if op == "baseline":
        return x - kernels.asymmetric_baseline(x, float(step["lam"]), int(step["order"]), float(step["p"]), int(step["itermax"]))
    if op == "wlsbaseline":
        return x - kernels.asymmetric_baseline(x, float(step["lam"]), int(step["d"]), float(step["p"]), int(step["n_iter"]))
    if op == "snv":
        s = x.std(axis=1, keepdims=True)
        return (x - x.mean(axis=1, keepdims=True)) / np.where(s > 0, s, 1)
    if op == "msc":
        r = np.array(state["reference"])
        c = r - r.mean()
        a = x @ c / max(float(c @ c), 1e-300)
        a = np.where(np.abs(a) < 1e-12, 1e-12, a)
        return (x - (x.mean(axis=1) - a * r.mean())[:, None]) / a[:, None]
    if op == "mean_center":
        return x - np.array(state["mean"])
    if op == "column_scale":
        return (x - np.array(state["mean"])) / np.array(state["scale"])
    x = x - np.array(state["mean"])
    for w, q in zip(state["w"], state["p"]):
        x = x - np.outer(x @ np.array(w), np.array(q))
    return x + np.array(state["mean"])


def osc_fit(xtx: np.ndarray, xty: np.ndarray, yty: float, n_components: int, tol: float) -> tuple[list, list]:
    """Weights and loadings orthogonal to y, from centred cross products alone."""
    ws, ps = [], []
    for _ in range(n_components):
        size = np.linalg.norm(xty)
        if size < 1e-12:
            break
        w = xty / size
        xt, yt, tt = xtx @ w, float(xty @ w), float(w @ xtx @ w)
        # t_orth = t - y (y.t) / (y.y), all products of it expand into the sums.
        beta = yt / yty if yty > 0 else 0.0
        oo = tt - beta * yt
        if np.sqrt(max(oo, 0)) < tol:
            break
        p = (xt - beta * xty) / oo
        ws.append(w.tolist())
        ps.append(p.tolist())
        # x <- x - t p' on all sums.
        xtx = xtx - np.outer(xt, p) - np.outer(p, xt) + tt * np.outer(p, p)
        xty = xty - yt * p
    return ws, ps


def fit(chain: list[dict], df: DataFrame, p: int) -> Fitted:
    """Fits each step on the output of those before it; ``df`` has x, and y where a step needs it.

    A column statistic or Gram aggregate runs per fitted step, none otherwise.
    """
    out = Fitted(canonical(chain), p)
    for step in out.steps:
        spec, state = SPECS[step["op"]], {}
        if spec.fitted:
            done = Fitted(out.steps[: len(out.state)], p, out.state).transform(df)
            if spec.target:
                if "y" not in df.columns:
                    raise ValueError(f"{step['op']} needs a target")
                g = gram(done).centred()
                ws, ps = osc_fit(g.xx, g.xy, g.yy, int(step["n_components"]), float(step["tol"]))
                state = {"mean": g.mean_x.tolist(), "w": ws, "p": ps}
            else:
                m, s = column_stats(done)
                state = {"reference": m.tolist()} if step["op"] == "msc" else {"mean": m.tolist()}
                if step["op"] == "column_scale":
                    state["scale"] = np.where(s > 0, s, 1.0).tolist()
        else:
            # Raise now what a bad parameter would raise later.
            linear_matrix(step, p)
            if step["op"] == "wavelet":
                kernels.wavelet_filter(step["wavelet"])
        out.state.append(state)
    return out


def global_standardize(df: DataFrame, column: str = "x") -> DataFrame:
    """All cells of the table to mean 0 and population sd 1, by one broadcast row.

    Each row gives its size, mean and squares around it; the native variance adds
    them up around the common mean, so a large mean costs no digits.
    """
    m = moments(F.col(column))
    rows = df.select(bound(m, lambda s: s).alias("m")).select("m.*")
    total = rows.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__m"))
    around = F.col("m2") + F.col("n") * (F.col("mean") - F.col("__m")) * (F.col("mean") - F.col("__m"))
    stats = rows.crossJoin(F.broadcast(total.select("__m"))).agg(F.first("__m").alias("__m"), F.sqrt(F.sum(around) / F.sum("n")).alias("__d"))
    scaled = F.transform(F.col(column), lambda v: (v - F.col("__m")) / F.when(F.col("__d") > 0, F.col("__d")).otherwise(1.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("__m", "__d")


def river_smooth(df: DataFrame) -> DataFrame:
    """Wiener, smoothing polynomial, then wavelet denoising from its second sample on."""

    def kernel(x: np.ndarray) -> np.ndarray:
        y = kernels.wiener(x)
        y = y @ kernels.smoothing_matrix(x.shape[1], 15, 3).T
        return kernels.wavelet_denoise(y, 2, full=True)[:, 1:]

    return batched(df, kernel)
