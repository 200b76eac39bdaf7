import datetime
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle

from specloom import queries
from specloom.operators import scoring, zoo
from specloom.operators.guards import WATER_PARAMS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows], float), np.array([r.embedding for r in rows], float)


def test_linearity_all(spark, embeddings):
    ids, x = embeddings
    got = {(r.j, r.concentration): r.r2 for r in queries.QUERIES["linearity_all"](spark, SF).collect()}
    assert len(got) == 64 * (len(ids) - 2) and len(ids) > 40
    for j in (7, 30, 56):
        at = np.arange(-7, 8)
        smooth = [np.polyval(np.polyfit(at, row[j - 7 : j + 8], 3), 0) for row in x]
        for k in (3, 40, len(ids)):
            assert abs(got[j, int(ids[k - 1])] - np.corrcoef(smooth[:k], ids[:k])[0, 1] ** 2) < 2e-5


def test_gram_products(spark, embeddings):
    x = embeddings[1]
    got = {(r.i, r.j): r.v for r in queries.QUERIES["gram_products"](spark, SF).collect()}
    assert len(got) == 2080
    assert all(abs(v - x[:, i] @ x[:, j]) < 1e-3 for (i, j), v in got.items())


@pytest.fixture(scope="module")
def zero_values(spark, tmp_path_factory):
    """Events of which some have the value zero, one of them after another zero: their relative errors are infinite or NaN."""
    rng, at = np.random.default_rng(0), str(tmp_path_factory.mktemp("zeros"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=7 * k), k % 7, f"t{k % 5}", round(float(rng.gamma(1, 50)), 2)) for k in range(3000)]
    rows = [(*r[:4], 0.0 if r[0] in (500, 505, 1001, 1502) else r[4]) for r in rows]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


def differing(spark, name, at):
    """The rows of a query and of its SQL that are not in the other, as text."""
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS FROM '{at}/events.parquet/*.parquet'")
        found = c.execute(queries.ORACLES[name])
        names, want = [x[0] for x in found.description], found.fetchall()
    got = queries.QUERIES[name](spark, at).select(*names).collect()
    assert len(got) == len(want) > 0
    return sorted(map(str, map(tuple, got))), sorted(map(str, want))


@pytest.mark.parametrize("name", ["score_rows", "rank_components", "top_models", "scoring_file"])
def test_zero_truths_as_in_sql(spark, zero_values, name):
    got, want = differing(spark, name, zero_values)
    assert got == want
    if name == "score_rows":
        assert sum("inf" in r for r in got) == 2 and sum("nan" in r for r in got) == 1


@pytest.fixture(scope="module")
def odd_events(spark, tmp_path_factory):
    """Events of types without variance, of few rows, of unknown values, times, ids and type, of negative zeros and tiny scores."""
    rng, at = np.random.default_rng(1), str(tmp_path_factory.mktemp("odd"))
    start = datetime.datetime(2024, 1, 1)
    value = lambda: round(float(rng.gamma(1, 50)), 2)
    kinds = {
        "gaps": [None if k % 9 < 2 else value() for k in range(200)],
        "flat": [5.5] * 40,
        "flatday": [5.5] * 40 + [value() for _ in range(40)],
        "lone": [5.5],
        "negzero": [-0.0 if k % 50 == 7 else value() for k in range(200)],
        "pair": [3.0, 4.0],
        "three": [5.0, 6.0, 9.0],
        "tiny": [-1e6 - k % 2 for k in range(40)],
        "untimed": [value() for _ in range(40)],
        "void": [None] * 40,
        None: [value() for _ in range(40)],
    }
    rows = [(1000 * i + k, start + datetime.timedelta(hours=k), 1, kind, v) for i, (kind, values) in enumerate(kinds.items()) for k, v in enumerate(values)]
    rows = [(None if r[0] % 7 == 3 else r[0], None if r[0] % 5 == 2 else r[1], *r[2:]) if r[3] == "untimed" else r for r in rows]
    # An id at least for each event without a time: the order must not be left open.
    rows = [(k, *r[1:]) if r[1] is None else r for k, r in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


def test_odd_scores_as_in_sql(spark, odd_events):
    got, want = differing(spark, "score_rows", odd_events)
    assert got == want and len(got) == 9
    assert any("tiny" in r and "-0.0," in r for r in got) and any("flat'" in r and "nan" in r for r in got)


def test_scores_of_constant_models(spark):
    """Undefined scores are null: no division by zero."""
    rows = [(kind, k, k // 5, t, p) for k in range(10) for kind, t, p in (("same", 2.0, 2.0), ("flat", float(k), 2.0))]
    df = spark.createDataFrame(rows, "model_type string, seq long, day_idx int, y_true double, y_pred double")
    got = {r.model_type: r for r in scoring.score_rows(df, WATER_PARAMS["TN"]).collect()}
    assert all(got[k][c] is None for k in got for c in ("pearson_r_score", "daily_pearson_r_score", "LM_p", "F_p"))
    assert got["same"].r2_score is None and got["flat"].r2_score == pytest.approx(1 - 145 / 82.5)


@pytest.mark.parametrize("case", ["unknown", "unlabelled", "none"])
def test_score_equations_of_unknown_values(spark, tmp_path, case):
    """Vectors that are unknown, empty or lack a channel, unknown labels, no labels, no rows: as in the SQL."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(0, 0.1, 6)], int(rng.integers(0, 10))) for k in range(120)]
    rows = [(k, None if k % 40 == 1 else [] if k % 40 == 2 else [None, *x[1:]] if k % 40 == 3 else x, None if k % 40 == 4 or case == "unlabelled" else y) for k, x, y in rows]
    spark.createDataFrame(rows if case != "none" else [], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(queries.ORACLES["score_equations"]).fetchall()
    got = queries.QUERIES["score_equations"](spark, str(tmp_path)).select("model", "j", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == (0 if case == "none" else 12)


def test_newton_step_needs_no_package_on_workers(tmp_path):
    """What a worker gets runs where this package can't be imported."""
    x, y, b = np.arange(6.0).reshape(3, 2), np.array([1.0, 2.0, 5.0]), np.array([0.1, 0.2, -0.1])
    m = zoo.build_model("poisson", alpha=0.1).fit(x, y)
    run = "import pickle, sys; f, x, y = pickle.load(sys.stdin.buffer); sys.stdout.buffer.write(f(x, y).tobytes())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", run], input=cloudpickle.dumps((m.weighted(b), x, y)), capture_output=True, cwd=tmp_path, env=env)
    assert not out.returncode, out.stderr.decode()
    assert np.allclose(np.frombuffer(out.stdout).reshape(3, 4), m.weighted(b)(x, y))


@pytest.mark.parametrize("odd", [[1.0], [1.0, None], [1.0, float("nan")]])
def test_models_on_tables_refuse_missing_channels(spark, odd):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([2.0, 1.0], 2.0), (odd, 3.0)], "x array<double>, y double")
    with pytest.raises(ValueError, match="2 channels"):
        zoo.build_model("poisson", alpha=0.1).fit_frame(df)
