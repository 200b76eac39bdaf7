"""Quality classifier: ridge on random Fourier features, isotonic calibration.

Statistics of each whole text (character classes, word and line repetition) are
taken once and kept as a narrow table. Random Fourier features of the scaled
statistics approximate a Gaussian kernel; every partition sums its part of the
normal equations of two folds, the parts are summed by row of the matrix, and
the driver solves systems of a fixed size. Scores of each fold by the other's
model, counted on a fixed grid, give the isotonic calibration; the final model
is fitted on both folds. All labelled rows count, none is collected.

Defined results: a null or empty text has all statistics zero and is scored;
without a labelled row of either class every score is 0.5; several labels of
one id are averaged; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, durable, named, utf8

FEATURES, SEED, RIDGE, WIDTH = 256, 11, 1e-3, 3.0
#: Out-of-fold scores are counted on this many steps between -0.5 and 1.5.
GRID = 1024

_CLASSES = [
    range(65, 91), range(97, 123), range(48, 58), [32], [10], [46, 44, 59, 58, 39, 45], [33],
    [35, 42, 36, 37, 38], [124], [60, 62, 47, 61, 123, 125], range(128, 256), [64],
]
_GROUPS = np.zeros((256, len(_CLASSES)))
for _k, _x in enumerate(_CLASSES):
    _GROUPS[list(_x), _k] = 1
N_STATS = len(_CLASSES) + 9


def statistics(text: bytes) -> list[float]:
    """Fixed-length statistics of a text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _GROUPS / len(text)
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *np.sqrt(shares).tolist(),
        float(np.log1p(n)),
        len(text) / n / 10,
        len(set(words)) / n,
        pairs / max(1, n - 1),
        (same / n) ** 0.5,
        (text.count(b"!!") / n) ** 0.5,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(max(map(len, words)))) / 4,
    ]


def statistics_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>): one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Fourier:
    """z(x) = sqrt(2 / D) cos(W (x - mean) / sd + b) and a constant."""

    mean: np.ndarray
    sd: np.ndarray
    features: int = FEATURES
    seed: int = SEED

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(size=(x.shape[1], self.features)) / WIDTH
        b = rng.uniform(0, 2 * np.pi, self.features)
        z = np.cos(np.clip((x - self.mean) / self.sd, -5, 5) @ w + b) * np.sqrt(2 / self.features)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each statistic over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        if n:
            j = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(np.full(len(j), n)), pa.array(total), pa.array(square)], names=["j", "n", "s", "ss"])

    parts = rows.select("x").mapInArrow(run, "j long, n long, s double, ss double")
    sums = parts.groupBy("j").agg(F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("j").collect()
    n, s, ss = (np.array([r[k] for r in sums], float) for k in (1, 2, 3))
    mean = s / n
    return mean, np.sqrt(np.maximum(ss / n - mean**2, 1e-8))


def normal_equations(rows: DataFrame, fourier: Fourier) -> dict[int, np.ndarray]:
    """Per fold the sums of [z, y]'[z, y] over ``rows(x, y, fold)``.

    A partition emits one row for each row of the matrix; rows of the same
    index are summed together, so the driver gets two matrices of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for start in range(0, len(x), 4096):
                part = slice(start, start + 4096)
                zy = np.concatenate([fourier(x[part]), y[part, None]], axis=1)
                for f in np.unique(fold[part]):
                    own = zy[fold[part] == f]
                    sums[int(f)] = sums.get(int(f), 0) + own.T @ own
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), f)), pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        v = _matrix(rows["v"].combine_chunks()).sum(0)
        return pa.table({"fold": pa.array([key[0].as_py()]), "i": pa.array([key[1].as_py()]), "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "fold long, i long, v array<double>"
    parts = rows.select("x", "y", "fold").mapInArrow(run, schema)
    out: dict[int, list] = {}
    for r in parts.groupBy("fold", "i").applyInArrow(summed, schema).orderBy("fold", "i").collect():
        out.setdefault(r.fold, []).append(r.v)
    return {f: np.array(m) for f, m in out.items()}


def solved(sums: np.ndarray) -> np.ndarray:
    n = sums[-2, -2]
    a = sums[:-1, :-1] + RIDGE * n * np.eye(len(sums) - 1)
    return np.linalg.solve(a, sums[:-1, -1])


def isotonic(counts: np.ndarray, positives: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over binned scores; block centres and rates."""
    blocks: list[list[float]] = []
    for n, y, p in zip(counts, positives, places):
        blocks.append([n, y, n * p])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks, float)
    return b[:, 2] / b[:, 0], b[:, 1] / b[:, 0]


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.round((raw + 0.5) * GRID / 2), 0, GRID).astype(np.int64)


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    at: np.ndarray
    rate: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for k in range(0, len(x), 4096):
            out[k : k + 4096] = np.interp(self.fourier(x[k : k + 4096]) @ self.weights, self.at, self.rate)
        return np.round(np.clip(out, 0, 1), 9)


def fit(stats: DataFrame, labels: DataFrame, learn: Column) -> Model | None:
    """A model of ``labels(doc_id, y)`` where ``learn`` (a column of doc_id) holds."""
    y = labels.where(learn & F.col("y").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    rows = durable(stats.join(y, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")))
    classes = rows.agg(F.min("y"), F.max("y")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return None
    fourier = Fourier(*scaling(rows))
    sums = normal_equations(rows, fourier)
    whole = solved(sum(sums.values()))
    by_fold = {f: solved(sums[1 - f]) if 1 - f in sums else whole for f in sums}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(GRID + 1), np.zeros(GRID + 1)
        for batch in batches:
            x, y, fold = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(0, len(x), 4096):
                z = fourier(x[k : k + 4096])
                raw = np.where(fold[k : k + 4096] == 0, z @ by_fold.get(0, whole), z @ by_fold.get(1, whole))
                at = _bin(raw)
                n += np.bincount(at, minlength=GRID + 1)
                s += np.bincount(at, weights=y[k : k + 4096], minlength=GRID + 1)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(s[hit])], names=["bin", "n", "s"])

    bins = rows.select("x", "y", "fold").mapInArrow(run, "bin long, n double, s double").groupBy("bin").agg(F.sum("n"), F.sum("s")).orderBy("bin").collect()
    place, n, s = (np.array([r[k] for r in bins], float) for k in range(3))
    return Model(fourier, whole, *isotonic(n, s, place * 2 / GRID - 0.5))


def score(stats: DataFrame, model: Model | None, cut: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of each row of statistics."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"), F.lit(int(0.5 >= cut)).alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(df: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted): fitted on ``labels(doc_id, y)`` where ``learn``, applied to all rows."""
    stats = durable(statistics_table(df, doc_id, text))
    return score(stats, fit(stats, labels, learn))


def learnable(modulus: int = 4, held: int = 2) -> Column:
    return F.coalesce(crc_bucket("doc_id", modulus) != held, F.lit(True))
