import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.operators import acceptance, fom, gram, guards, hardware, hypothesis, linear, mspc, preprocess, scoring, selection, sequences, spectra, transfer, unmixing, zoo
from specloom.operators.guards import WATER_PARAMS, WaterParam

AXIS = np.linspace(200, 700, 101)


def peak(axis, at, width):
    return np.exp(-0.5 * ((axis - at) / width) ** 2)


def mixture(n=120, seed=0, noise=1e-3):
    rng = np.random.default_rng(seed)
    s = np.stack([peak(AXIS, *v) for v in ((260, 20), (340, 30), (520, 40))])
    c = rng.uniform(size=(n, 3)) * [1, 0.5, 0.3]
    return c @ s + rng.normal(0, noise, (n, 101)), 2 * c[:, 0] + 0.1


def frame(spark, x, y=None, **more):
    cols = {"sample_id": range(len(x)), "x": [list(map(float, r)) for r in x]}
    if y is not None:
        cols["y"] = [float(v) for v in y]
    cols |= more
    kinds = {"sample_id": "long", "x": "array<double>", "y": "double", "day_idx": "int", "std_id": "long", "concentration": "double"}
    return spark.createDataFrame([tuple(r) for r in zip(*[list(v) for v in cols.values()])], ", ".join(f"{k} {kinds[k]}" for k in cols))


def xs(df):
    return np.array([r.x for r in df.orderBy("sample_id").collect()])


# spectra


def test_layouts_round_trip(spark):
    x = np.random.default_rng(0).normal(size=(5, 101))
    df = frame(spark, x)
    assert np.array_equal(xs(spectra.to_arrays(spectra.to_long(df, AXIS), "sample_id")), x)
    cut, axis = spectra.clip_wavelengths(df, AXIS, 250, 300)
    assert axis[0] == 250 and axis[-1] == 300 and xs(cut).shape == (5, len(axis))
    assert spectra.clip_wavelengths(df, AXIS, 1, 2)[1] == []
    assert xs(spectra.trim_bands(df, AXIS)[0]).shape == (5, 81)
    assert spectra.shape(df, AXIS) == {"n_samples": 5, "n_wavelengths": 101, "step": 5.0}
    with pytest.raises(KeyError):
        spectra.sort_by(df, "no")
    with pytest.raises(Exception, match="channels expected"):
        spectra.validate(df, AXIS[:-1]).collect()


# preprocessing


@pytest.mark.parametrize(
    "chain",
    [
        [{"op": "savgol"}],
        [{"op": "deriv_gram", "der": 1}],
        [{"op": "snv"}],
        [{"op": "msc"}],
        [{"op": "mean_center"}],
        [{"op": "column_scale"}],
        [{"op": "osc"}],
        [{"op": "whittaker", "lam": 10.0}],
        [{"op": "baseline", "lam": 1e3}],
        [{"op": "wlsbaseline", "lam": 1e3}],
        [{"op": "savgol"}, {"op": "wavelet"}, {"op": "snv"}],
        [{"op": "savgol"}, {"op": "whittaker"}, {"op": "mean_center"}],
    ],
    ids=lambda c: "+".join(s["op"] for s in c),
)
def test_chains_give_the_same_on_tables_and_arrays(spark, chain):
    x, y = mixture(30)
    df = frame(spark, x, y)
    fitted = preprocess.fit(chain, df, 101)
    again = preprocess.Fitted.from_json(fitted.to_json())
    assert np.allclose(xs(again.transform(df)), fitted.apply(x), atol=1e-9)
    assert np.allclose(xs(fitted.transform(df.where("sample_id = 3"))), fitted.apply(x)[3:4], atol=1e-9)


def test_snv_and_msc(spark):
    rows = np.outer(np.linspace(0.5, 1.5, 8), peak(np.arange(101), 50, 20) + 0.5) + np.linspace(0, 0.3, 8)[:, None]
    df = frame(spark, rows)
    z = xs(preprocess.fit([{"op": "snv"}], df, 101).transform(df))
    assert np.allclose(z.mean(1), 0) and np.allclose(z.std(1), 1)
    m = xs(preprocess.fit([{"op": "msc"}], df, 101).transform(df))
    assert m.std(0).max() < 0.1 * rows.std(0).max()
    assert np.allclose(xs(df.limit(1).withColumn("x", preprocess.snv(F.array_repeat(F.lit(2.0), 5)))), 0)


def test_osc_is_orthogonal_to_the_target(spark):
    x, y = mixture(40)
    df = frame(spark, x, y)
    fitted = preprocess.fit([{"op": "osc"}], df, 101)
    t = (x - x.mean(0)) @ np.array(fitted.state[0]["w"][0])
    assert fitted.apply(x).shape == x.shape and abs(np.corrcoef(t, y)[0, 1]) > 0.5
    with pytest.raises(ValueError):
        preprocess.fit([{"op": "osc"}], frame(spark, x), 101)


def test_bad_chains():
    for chain, error in (([{"no": 1}], ValueError), ([{"op": "nope"}], preprocess.CompileError), ([{"op": "snv", "k": 1}], ValueError)):
        with pytest.raises(error):
            preprocess.canonical(chain)
    assert preprocess.canonical([{"op": "savgol"}]) == [{"op": "savgol", "window": 15, "polyorder": 3, "deriv": 0}]


def test_global_scaling_and_river(spark):
    x, _ = mixture(6)
    z = xs(preprocess.global_standardize(frame(spark, x)))
    assert z.mean() == pytest.approx(0, abs=1e-9) and z.std() == pytest.approx(1)
    assert xs(preprocess.river_smooth(frame(spark, x))).shape == (6, 101)


# guards


def test_bounds_and_classes(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.03, 2.0, 3.5, 100.0, float("nan"), None)], "v double")
    b = guards.bounds(F.col("v"), 0.025, 3, 4)
    got = [tuple(r) for r in df.select(*b.values()).collect()]
    assert [r[0] for r in got[:6]] == [0.0125, 0.0125, 0.03, 2.0, 3.5, None]
    assert [r[1:] for r in got] == [(True, False, False)] * 2 + [(False, False, False)] * 2 + [(False, True, False), (False, False, True)] + [(False, False, False)] * 2
    v = spark.createDataFrame([(x,) for x in (0.1, 0.3, 1.2, 3.0, 15.0)], "v double")
    assert [r[0] for r in v.select(guards.water_class(F.col("v"), WATER_PARAMS["TN"].ranges)).collect()] == [0, 1, 3, 5, 5]
    assert [r[0] for r in v.select(guards.water_class(F.col("v"), WATER_PARAMS["COD"].ranges)).collect()] == [0, 0, 0, 0, 2]
    assert WATER_PARAMS["TN"].theoretical_upper() == 10 and WATER_PARAMS["TN"].theoretical_upper(3) == 3
    with pytest.raises(ValueError):
        guards.range_limit(F.col("v"), 0)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "seq long, day_idx int, y_true double, y_pred double")


def test_acceptance(spark):
    day = pairs(spark, [(i, d, t, t + 0.01) for i, (d, t) in enumerate(((1, 1.0), (1, 2.0), (1, 3.0), (2, 10.0), (2, 11.0), (2, 12.0), (3, 1.0)))])
    r = {x.day_idx: x.r2 for x in acceptance.daily_r2(day).collect()}
    assert set(r) == {1, 2} and all(v > 0.99 for v in r.values())
    a = acceptance.alarm(pairs(spark, [(0, 0, 0.1, 0.1), (1, 0, 0.2, 2.0), (2, 0, 2.0, 2.1), (3, 0, 3.0, 0.3)]), 1.0).first()
    assert (a.tp, a.fp, a.fn, a.tn, a.accuracy) == (1, 1, 1, 1, 0.5)
    p = WaterParam("AN", (0.15, 0.5, 1, 1.5, 2), 0.025, 3, 0.2)
    truth = (0.1, 1.0, 2.5)
    rate = lambda pred: acceptance.acceptance_rate(pairs(spark, [(i, 0, t, v) for i, (t, v) in enumerate(zip(truth, pred))]), p).first()[0]
    assert rate((0.11, 1.05, 2.4)) == 1.0 and rate((1.9, 1.9, 0.05)) == 0.0
    report = acceptance.acceptance_report(day, p, day="day_idx")
    assert report["errors"].first().rmse == pytest.approx(0.01) and report["confusion"].agg(F.sum("n")).first()[0] == 7
    assert acceptance.acceptance_rate(day.limit(0), p).first()[0] is None


# scoring


def test_score_rows_against_numpy(spark):
    rng = np.random.default_rng(0)
    t = rng.uniform(1, 5, 60)
    p = t + rng.normal(0, 0.3, 60)
    df = spark.createDataFrame([("m", i, i // 10, float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))], "model_type string, seq long, day_idx int, y_true double, y_pred double")
    r = scoring.score_rows(df, WATER_PARAMS["TN"]).first()
    e = p - t
    assert r["durbin_watson_value"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    runs = 1 + (np.sign(e[1:]) != np.sign(e[:-1])).sum()
    assert r["bad grouped ratio"] == pytest.approx(min(1, max(0, 1 - runs / 30.5)))
    z = e - e.mean()
    assert r["Kurtosis"] == pytest.approx((z**4).mean() / (z**2).mean() ** 2 - 3) and r["skew"] == pytest.approx((z**3).mean() / (z**2).mean() ** 1.5)
    assert r["F_p"] < 1e-6 and 0 < r["LM_p"] < 1 and r["pearson_r_score"] == pytest.approx(np.corrcoef(t, p)[0, 1])
    assert set(scoring.COLUMNS) - {"rank"} == set(scoring.score_rows(df, WATER_PARAMS["TN"]).columns)


def test_ranks(spark):
    rows = spark.createDataFrame([("a", 0.9), ("b", -0.1), ("c", -10.0)], "model_type string, r2_score double")
    ranks = {r.model_type: r["rank"] for r in scoring.rank_models(rows, [("r2_score", "desc", "leveraged")]).collect()}
    assert ranks == pytest.approx({"a": 0, "b": 1 + 2 * 0.1 / 1.1, "c": 2 + 2 * 10 / 11})
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "model_type string, rmse double")
    assert [r["rank"] for r in scoring.rank_models(tied, [("rmse", "asc", "competition")]).collect()] == [0, 0, 2, 3]
    assert [r.model_type for r in scoring.select_top_k(scoring.rank_models(tied, [("rmse", "asc", "ordinal")]), 9).collect()] == ["a", "b", "c", "d"]
    old = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "model_type string, mape double")
    new = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("c", 0.5)], "model_type string, mape double")
    assert {r.model_type: r.mape for r in scoring.upsert_scores(old, new).collect()} == {"a": 0.1, "b": 0.1, "c": 0.5}


# series


def test_charts_against_loops(spark):
    x = np.random.default_rng(0).normal(5, 2, 80)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "series long, seq long, value double")
    z = (x - x.mean()) / x.std(ddof=1)
    up = down = 0.0
    want = []
    for i, v in enumerate(z):
        if i:
            up, down = max(0, up + v - 0.5), min(0, down + v + 0.5)
        want.append((up, down))
    got = [(r.c_pos, r.c_neg) for r in sequences.cusum(df).orderBy("seq").collect()]
    assert np.allclose(got, want, atol=1e-12)
    e, value = [], x.mean()
    for v in x:
        value = 0.2 * v + 0.8 * value
        e.append(value)
    assert np.allclose([r.ewma for r in sequences.ewma(df).orderBy("seq").collect()], e)
    c = x - x.mean()
    rho = np.clip((c[1:] * c[:-1]).sum() / (c * c).sum(), -0.99, 0.99)
    n_eff = max(1, 80 * (1 - rho) / (1 + rho))
    r = sequences.shewhart_limits(df).first()
    assert r.ucl == pytest.approx(x.mean() + 3 * x.std(ddof=1) / math.sqrt(n_eff))
    assert sequences.arl0(3) == pytest.approx(370.4, abs=0.1)
    u = np.array([r.value for r in sequences.unimodal(df).orderBy("seq").collect()])
    top = x.argmax()
    assert (np.diff(u[: top + 1]) >= 0).all() and (np.diff(u[top:]) <= 0).all()


def test_folds(spark):
    days = spark.createDataFrame([(d,) for d in (0, 0, 5, 5, 9, 9, 12)], "day_idx int")
    for scheme, window in (("expanding", None), ("rolling", 1), ("logo", None)):
        rows = sequences.day_folds(days, scheme, window).collect()
        for fold in {r.fold for r in rows}:
            (test,) = [r.day_idx for r in rows if r.fold == fold and r.role == "test"]
            train = [r.day_idx for r in rows if r.fold == fold and r.role == "train"]
            assert train and test not in train
            assert scheme == "logo" or max(train) < test
            assert scheme != "rolling" or len(train) == 1
    with pytest.raises(ValueError):
        sequences.day_folds(days, "rolling")
    parts = sequences.kfold(11, 3, 0)
    assert sorted(np.concatenate(parts)) == list(range(11)) and [len(p) for p in parts] == [4, 4, 3]


# models


def test_gram_adds_up(spark):
    x, y = mixture(50)
    df = frame(spark, x, y, day_idx=[i % 3 for i in range(50)])
    parts = gram.grams(df, "day_idx")
    assert np.allclose(sum((g.m for g in parts.values())), gram.gram(df).m)
    assert np.allclose(gram.gram(df).m, gram.Gram.of(x, y).m)
    with pytest.raises(ValueError):
        gram.gram(df.limit(0))


def nipals(x, y, k):
    """PLS1 on columns scaled by their sample sd, as a plain loop."""
    m, s, my = x.mean(0), x.std(0, ddof=1), y.mean()
    e, f = (x - m) / s, y - my
    w, p, q = [], [], []
    for _ in range(k):
        v = e.T @ f
        v /= np.linalg.norm(v)
        t = e @ v
        w.append(v)
        p.append(e.T @ t / (t @ t))
        q.append(f @ t / (t @ t))
        e, f = e - np.outer(t, p[-1]), f - t * q[-1]
    w, p = np.array(w).T, np.array(p).T
    return w @ np.linalg.solve(p.T @ w, np.array(q)) / s


@pytest.mark.parametrize("k", [1, 3, 8])
def test_pls_against_nipals(k):
    x, y = mixture()
    assert np.allclose(linear.pls(gram.Gram.of(x, y).centred(), k), nipals(x, y, k), atol=1e-9)


def test_pls_stays_put_once_it_has_converged():
    """Components past the last that explains anything: as many samples as make rounding outweigh an absolute floor."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 64))
    y = x @ np.eye(64)[[5, 20, 40]].T @ [2, -1, 0.5]
    path = linear.pls_path(gram.Gram.of(x, y).centred(), 60)
    want = np.eye(64)[[5, 20, 40]].T @ [2, -1, 0.5]
    assert np.abs(path[25:] - want).max() < 1e-9


def test_linear_solvers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    y = x @ [3.0, 0, 0, -2, 0, 0] + 1
    c = gram.Gram.of(x, y).centred()
    for name in ("ols", "lars"):
        assert np.allclose(linear.SOLVERS[name](c), [3, 0, 0, -2, 0, 0], atol=1e-6), name
    assert np.allclose(linear.omp(c, 2), [3, 0, 0, -2, 0, 0], atol=1e-8)
    assert np.allclose(linear.pcr(c, 6), [3, 0, 0, -2, 0, 0], atol=1e-8)
    b = linear.ridge(c, 5.0)
    assert np.allclose((c.xx + 5 * np.eye(6)) @ b, c.xy)
    b = linear.lasso(c, 0.5)
    slope = (c.xy - c.xx @ b) / c.n
    assert np.allclose(np.abs(slope[b != 0]), 0.5, atol=1e-4) and (np.abs(slope) <= 0.5 + 1e-4).all() and (b == 0).sum() == 4


@pytest.mark.parametrize("key", ["huber", "quantile", "theilsen", "sgd", "krr", "gpr", "svr", "mlp", "gam", "poisson", "gamma", "tweedie"])
def test_other_models_learn(key):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (120, 3))
    y = 2 * x[:, 0] + x[:, 1] + 1.0
    params = {"krr": {"alpha": 0.01}, "poisson": {"alpha": 1e-4}, "gamma": {"alpha": 1e-4}, "tweedie": {"alpha": 1e-4}, "svr": {"c": 10.0, "epsilon": 0.01}}.get(key, {})
    target = y - y.mean() if key == "krr" else y
    pred = zoo.build_model(key, **params).fit(x - (x.mean(0) if key == "krr" else 0), target).predict(x - (x.mean(0) if key == "krr" else 0))
    assert np.sqrt(np.mean((pred - target) ** 2)) < 0.2 * y.std()


def test_huber_is_the_least_of_its_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) * [1, 10, 0.1, 3]
    y = x @ [1, 0.2, 5, 0] + rng.normal(size=200)
    y[:10] += 30
    m = zoo.build_model("huber", alpha=0.5).fit(x, y)

    def loss(p):
        r = np.abs(y - x @ p[:4] - p[4]) / p[5]
        return (p[5] * (1 + np.where(r < 1.35, r * r, 2.7 * r - 1.35**2))).sum() + 0.5 * p[:4] @ p[:4]

    at = np.concatenate([m.coef_, [m.intercept_, m.scale_]])
    assert all(loss(at + 1e-3 * rng.normal(size=6)) > loss(at) for _ in range(200))


@pytest.mark.parametrize("key,power", [("poisson", 1), ("gamma", 2), ("tweedie", 0)])
def test_generalised_models_solve_their_score_equations(key, power):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3)) * [1, 5, 0.2]
    y = rng.poisson(np.exp(0.3 + x @ [0.2, 0.05, 1])) + 1.0
    m = zoo.build_model(key, alpha=0.1).fit(x, y)
    mu = m.predict(x)
    slope = 1 if key == "tweedie" else mu
    assert np.allclose(x.T @ ((y - mu) / mu**power * slope), len(y) * 0.1 * m.coef_, atol=1e-6)
    assert abs(((y - mu) / mu**power * slope).sum()) < 1e-6


@pytest.mark.parametrize("key", ["poisson", "gamma", "tweedie"])
def test_generalised_models_fit_on_tables(spark, key):
    """The same coefficients as on arrays, rows without a target left out, on a table that may not be fetched."""
    rng = np.random.default_rng(2)
    n = zoo.MAX_CALIBRATION + 500
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
    y = rng.poisson(np.exp(0.3 + x @ [0.2, 0.05, 1])) + 1.0
    rows = [(a.tolist(), float(b)) for a, b in zip(x, y)] + [([1.0, 1.0, 1.0], None), ([2.0, 1.0, 1.0], float("nan"))]
    df = spark.createDataFrame(rows, "x array<double>, y double").cache()
    with pytest.raises(ValueError):
        zoo.calibration(df)
    there, here = zoo.build_model(key, alpha=0.1).fit_frame(df), zoo.build_model(key, alpha=0.1).fit(x, y)
    assert np.allclose(there.coef_, here.coef_, atol=1e-9)
    got = np.array([r.mu for r in there.transform(df.limit(50), "mu").collect()])
    assert np.allclose(got, here.predict(x[:50]), atol=1e-8)


def test_registry():
    assert {"ols", "pls", "rf", "gam"} <= set(zoo.MODELS.keys()) and "latent" in zoo.MODELS.families()
    assert zoo.MODELS.keys(family="latent") == ["pcr", "pls"]
    with pytest.raises(KeyError):
        zoo.MODELS.register("ols")(object)
    with pytest.raises(KeyError):
        zoo.MODELS.get("nope")
    assert set(transfer.TRANSFER.keys()) == {"sbc", "ds", "pds", "glsw", "meanvar"} and transfer.TRANSFER.meta("ds")["min_samples"] == 20


# monitoring, transfer, selection, unmixing


def test_mspc_finds_the_planted_row(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 20))
    x = f + rng.normal(0, 0.01, (40, 20))
    v = rng.normal(size=20)
    basis = np.linalg.svd(f, full_matrices=False)[2][:3]
    v -= basis.T @ (basis @ v)
    bad = x.copy()
    bad[0] += 5 * v
    assert mspc.flag_outliers(frame(spark, bad), 3).first().sample_id == 0
    model = mspc.fit(frame(spark, x), 3)
    out = model.monitor(frame(spark, x)).orderBy("sample_id").collect()
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    t2 = ((u[:, :3] * s[:3]) ** 2 / (s[:3] ** 2 / 39)).sum(1)
    rest = x - x.mean(0) - (u[:, :3] * s[:3]) @ vt[:3]
    assert np.allclose([r.t2 for r in out], t2) and np.allclose([r.spe for r in out], (rest**2).sum(1), atol=1e-9)
    assert mspc.explained_variance(frame(spark, x)).sum() == pytest.approx(1)


def instruments(seed=7, n=80):
    rng, axis = np.random.default_rng(seed), np.arange(200, 451, 4.0)
    s = np.stack([peak(axis, 260, 25), peak(axis, 420, 25)])
    master = rng.uniform(size=(n, 2)) @ s + rng.normal(0, 1e-4, (n, len(axis)))
    gain = 1.15 + 0.25 * np.sin(np.linspace(0, 3, len(axis)))
    slave = np.roll(master * gain + 0.02, 1, axis=1) + rng.normal(0, 3e-4, master.shape)
    return axis, slave, master


def test_transfer(spark):
    axis, slave, master = instruments()
    ids = list(range(len(slave)))
    p = transfer.pairs(frame(spark, slave, std_id=ids), frame(spark, master, std_id=ids))
    before = np.abs(slave - master).mean()
    for fitted in (transfer.piecewise(p, 3), transfer.direct(p, 1e-4), transfer.mean_variance(p)):
        assert np.abs(fitted.apply(slave) - master).mean() < 0.5 * before
        assert np.allclose(xs(fitted.transform(frame(spark, slave[:3]))), fitted.apply(slave[:3]))
    w = transfer.weighting(p)
    assert np.abs(w.apply(slave) - w.apply(master)).mean() < np.abs(slave - master).mean() / 0.5
    g = transfer.gain_offset(p).orderBy("j").collect()
    want = np.polyfit(slave[:, 10], master[:, 10], 1)
    assert (g[10].gain, g[10].offset) == pytest.approx(tuple(want))
    assert transfer.wavelength_shift(axis, frame(spark, slave), frame(spark, master), 12.0) == -4.0
    assert transfer.wavelength_shift(axis, frame(spark, master), frame(spark, master), 0.1) == 0.0
    assert transfer.recommend(axis, -2.0, 10)["method"] == "align_then_pds" and transfer.recommend(axis, 2.0, 4)["need_alignment"]
    assert transfer.recommend(axis, 0.5, 1000)["method"] == "ds"
    assert transfer.recommend(axis, 0.0, 3)["method"] == "sbc" and transfer.recommend(axis, 0.0, 10)["method"] == "pds"


def test_kennard_stone(spark):
    x = np.random.default_rng(3).uniform(size=(50, 5))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    chosen = [int(d.sum(1).argmax())]
    while len(chosen) < 10:
        nearest = d[:, chosen].min(1)
        nearest[chosen] = -1
        chosen.append(int(nearest.argmax()))
    assert transfer.kennard_stone(frame(spark, x), 10) == sorted(chosen)


def test_selection(spark):
    x, y = mixture(60)
    df = frame(spark, x, y=[float(v) for v in y])
    for cars in (selection.Cars(n_iter=8, n_components=3).fit(x, y), selection.Cars(n_iter=8, n_components=3).fit_frame(df)):
        assert 2 <= len(cars.selected_) < 101 and cars.best_rmsecv_ < 0.1 * y.std() and cars.transform(x).shape[1] == len(cars.selected_)
        assert len(cars.curve_) == 8 and cars.best_rmsecv_ == min(cars.curve_)
    assert selection.Cars(n_iter=5, keep_min=2).schedule(32).tolist() == [32, 16, 8, 4, 2]
    uve = selection.Uve(3, 10)
    here, there = uve.fit(x, y).stability_, selection.Uve(3, 10).fit_frame(df.coalesce(1)).stability_
    assert np.isin(uve.selected_, np.arange(101)).all() and len(here) == 101 == len(there)
    r = selection.permutation_test(df, lambda a, b: selection.Cars(4, 3).fit(a, b).best_rmsecv_, 5)
    assert r["p"] < 0.5 and len(r["null"]) == 5 and r["real"] < min(r["null"])
    f = selection.selection_stability(df, lambda: selection.Cars(4, 3), 4).toPandas()
    assert len(f) == 101 and f.frequency.max() <= 1 and f.frequency.sum() > 0
    design = selection.diagonal_design(spark, 5, ((0, 1), (2, 4))).orderBy("component", "level").collect()
    assert len(design) == 11 and (design[0].c0, design[0].c1) == (0.5, 3.0) and [d.c1 for d in design[6:]] == [2.0, 2.5, 3.0, 3.5, 4.0]


def test_mcr(spark):
    rng, axis = np.random.default_rng(0), np.linspace(220, 700, 80)
    s = np.stack([peak(axis, a, w) for a, w in ((280, 30), (400, 40), (580, 50))])
    x = rng.uniform(size=(60, 3)) @ s
    df = frame(spark, x)
    start = unimixed = unmixing.simplisma(df, 3)
    assert all(min(abs(int(r.argmax()) - int(t.argmax())) for r in start) <= 15 for t in s) and unimixed.shape == (3, 80)
    done = unmixing.mcr_als(df, 3, max_iter=12)
    cosine = np.abs(unmixing.normalised(s) @ done.spectra.T)
    assert (cosine.max(1) > 0.95).all() and done.error < 0.05 * np.linalg.norm(x)
    c = np.array([r.c for r in unmixing.project(df, done.spectra, closure=True).collect()])
    assert (c >= 0).all() and np.allclose(c.sum(1), 1)
    assert len(unmixing.orthogonal_projection(df, 2)) == 2
    assert unmixing.ambiguity(df, done, n_trials=1, max_iter=3) < 0.5


def test_purest_channels_by_residuals(spark):
    x, k = np.abs(mixture(40)[0]), 3
    alpha = 0.05 * np.abs(x.mean(0)).max()
    share, on = np.ones(x.shape[1]), []
    for _ in range(k):
        score = x.std(0) / (np.abs(x.mean(0)) + alpha) * share
        score[on] = -1
        on.append(int(score.argmax()))
        fit = np.linalg.lstsq(x[:, on], x, rcond=None)[0]
        share = np.linalg.norm(x - x[:, on] @ fit, axis=0) / np.linalg.norm(x, axis=0)
    assert np.allclose(unmixing.simplisma(frame(spark, x), k), unmixing.normalised(np.maximum(fit, 0)), atol=1e-6)


def test_mcr_with_single_peaks(spark):
    rng, t = np.random.default_rng(0), np.arange(30)
    c = np.stack([np.exp(-(((t - m) / 5) ** 2)) for m in (8, 20)], axis=1) + rng.uniform(0, 0.05, (30, 2))
    s = np.stack([peak(AXIS, a, w) for a, w in ((280, 30), (520, 40))])
    df = frame(spark, c @ s)
    done = unmixing.mcr_als(df, 2, max_iter=4, unimodality=True)
    found = unmixing.single_peaks(unmixing.project(df, done.spectra))
    for v in np.array([r.c for r in found.orderBy("sample_id").collect()]).T:
        top = int(v.argmax())
        assert (np.diff(v[: top + 1]) >= 0).all() and (np.diff(v[top + 1 :]) <= 0).all()
    assert unmixing.feasible_bands(df, 30)["spectra"]


# tests, intervals, hardware, figures of merit


def test_hypotheses(spark):
    rng = np.random.default_rng(0)
    groups = [rng.normal(0, s, 20) for s in (1, 1, 1, 4)]
    df = spark.createDataFrame([(g, float(v)) for g, vs in enumerate(groups) for v in vs], "group int, v double")
    var = [v.var(ddof=1) for v in groups]
    assert hypothesis.cochran(df)["statistic"] == pytest.approx(max(var) / sum(var)) and hypothesis.cochran(df)["reject"]
    z = [np.abs(v - np.median(v)) for v in groups]
    mean = np.mean(np.concatenate(z))
    want = (sum(20 * (a.mean() - mean) ** 2 for a in z) / 3) / (sum(((a - a.mean()) ** 2).sum() for a in z) / 76)
    assert hypothesis.levene(df)["statistic"] == pytest.approx(want)
    assert hypothesis.bartlett(df)["p"] < 1e-6 and not hypothesis.consistency_report(df)["homogeneous"]
    one = spark.createDataFrame([(float(v),) for v in [*rng.normal(0, 1, 30), 9.0]], "v double")
    assert hypothesis.grubbs(one)["suspect"] == 9.0 and hypothesis.grubbs(one.limit(2))["suspect"] is None
    low, high = hypothesis.mean_interval(one)
    assert low < one.agg(F.avg("v")).first()[0] < high
    for kind in ("content", "expectation", "nonparametric"):
        a, b = hypothesis.tolerance_interval(one, kind=kind)
        assert a < b
    sixty = spark.createDataFrame([(float(v),) for v in rng.permutation(60)], "v double")
    # 57 of 60 are wanted: one value is left out at either end.
    assert hypothesis.tolerance_interval(sixty, 0.95, kind="nonparametric") == (1.0, 58.0)
    single = spark.createDataFrame([(4.0,)], "v double")
    assert hypothesis.mean_interval(single) == hypothesis.prediction_interval(single) == (4.0, 4.0)
    assert hypothesis.precision_summary(single) == {"n": 1, "mean": 4.0, "sd": 0.0, "rsd": 0.0, "ci": (4.0, 4.0), "ti": (4.0, 4.0)}
    assert hypothesis.mean_interval(single.limit(0)) == (None, None)
    assert hypothesis.precision_summary(one)["n"] == 31 and hypothesis.prediction_interval(one)[0] < low


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(hypothesis, "RANK_ROWS", 7)
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=501), "b": np.repeat(3.0, 40), "c": rng.lognormal(0, 4, 200), "d": np.array([2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = hypothesis.order_statistics(df, {"first": F.lit(0), "upper": F.floor(F.col("n") / 2), "last": F.col("n") - 1}, "g").collect()
    want = {g: (len(v), *np.sort(v)[[0, len(v) // 2, -1]]) for g, v in groups.items()}
    assert {r.g: (r.n, r.first, r.upper, r["last"]) for r in got} == want


@pytest.mark.parametrize("lam", [0.2, 0.9, 1.0])
def test_ewma_over_blocks(spark, lam):
    x = np.random.default_rng(1).normal(1e3, 5, 1500)
    df = spark.createDataFrame([(None if k % 2 else "s", k, float(v)) for k, v in enumerate(x)], "series string, seq long, value double")
    for name, part in (("s", x[::2]), (None, x[1::2])):
        got = sorted((r.seq, r.ewma, r.ucl, r.alarm) for r in sequences.ewma(df, lam).where(F.col("series").eqNullSafe(F.lit(name))).collect())
        z, half = sequences.ewma_values(part, lam, 3.0, part.mean(), part.std(ddof=1))
        assert np.allclose([g[1] for g in got], z, rtol=1e-12) and np.allclose([g[2] for g in got], part.mean() + half)
        assert [g[3] for g in got] == (np.abs(z - part.mean()) > half).tolist()


def test_clean_loop(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 12)) + rng.normal(0, 0.01, (60, 12))
    x[7] += 8 * rng.normal(size=12)
    left, gone = mspc.clean_loop(frame(spark, x), n_components=3, by="spe")
    ids = {r.sample_id for r in left.select("sample_id").collect()}
    assert 7 not in ids and gone[0] >= 1 and len(ids) == 60 - sum(gone)


def test_registered_operation(spark):
    from specloom.operators import preprocess

    @preprocess.register_op("halved", "scaling", by=2.0)
    def halved(x, by):
        return x / by

    try:
        x, _ = mixture(5)
        fitted = preprocess.fit([{"op": "halved", "by": 4.0}, {"op": "mean_center"}], frame(spark, x), 101)
        assert np.allclose(xs(fitted.transform(frame(spark, x))), fitted.apply(x)) and np.allclose(fitted.apply(x), (x - x.mean(0)) / 4)
        with pytest.raises(KeyError):
            preprocess.register_op("snv", "scatter")(halved)
    finally:
        del preprocess.SPECS["halved"], preprocess.KERNELS["halved"]


def test_instrument_from_measurements(spark):
    rng, axis = np.random.default_rng(0), np.arange(200.0, 700.0)
    shape = sum(np.exp(-0.5 * ((axis - nm - 0.2) / 2) ** 2) for nm in hardware.REFERENCE_PEAKS)
    dark, good = rng.normal(0, 2e-4, (20, 500)), shape + rng.normal(0, 1e-5, (10, 500))
    line = np.exp(-0.5 * ((axis - 546.1) / 0.6) ** 2)
    out = hardware.evaluate_instrument(axis, dark=frame(spark, dark), blank=frame(spark, dark), filters=frame(spark, good), certified=[(279.0, float(shape[79]))], line=(line, 546.1))
    assert out["passed"]["dark_noise_max"] and out["passed"]["wavelength_accuracy"] and out["passed"]["photometric_accuracy"] and out["overall"]
    assert abs(out["metrics"]["wavelength_accuracy"] - 0.2) < 0.1 and 1.0 < out["metrics"]["resolution"] < 2.0


def test_hardware(spark):
    rng = np.random.default_rng(0)
    noise = hardware.dark_noise(frame(spark, rng.normal(0, 0.001, (20, 50)))).first()
    assert noise.dark_noise_mean == pytest.approx(0.001, rel=0.15) and noise.dark_noise_max > noise.dark_noise_mean
    assert hardware.dark_noise(frame(spark, np.ones((1, 5)))).first().dark_noise_max is None
    assert hardware.signal_to_noise(frame(spark, 1 + rng.normal(0, 0.01, (50, 1)))) == pytest.approx(100, abs=15)
    axis = np.linspace(300, 420, 500)
    long = spectra.to_long(frame(spark, [peak(axis, 361.2, 3 / 2.3548)]), axis)
    assert hardware.wavelength_accuracy(long, (360.9,)).first()[1] == pytest.approx(0.3, abs=0.05)
    assert hardware.peaks(long, (800.0,)).count() == 0
    fine = np.linspace(540, 552, 1200)
    assert hardware.resolution(fine, peak(fine, 546.1, 1.5 / 2.3548), 546.1) == pytest.approx(1.5, abs=0.15)
    assert math.isnan(hardware.resolution(fine, fine, 900))
    cut = np.where(axis < 400, 0.0, 100.0)
    assert hardware.stray_light(axis, cut, [320, 350]) == 0 and hardware.photometric_accuracy([1, 2], [0, 1], [(1.5, 0.5)]) == pytest.approx(0)
    r = hardware.evaluate({"dark_noise_max": 0.0005, "snr": 10, "stray_light": 5.0})
    assert r["passed"] == {"dark_noise_max": True, "stray_light": False} and not r["overall"]
    c = np.array([1.0, 2, 3, 4, 5])
    df = frame(spark, np.outer(c, np.ones(7)), concentration=c.tolist())
    assert all(x.r2 is None if x.k < 2 else x.r2 == pytest.approx(1) for x in hardware.linearity(df, 7, 5, 2).collect())


def test_figures_of_merit(spark):
    coef = np.zeros(40)
    coef[10:20] = 0.5
    blanks = frame(spark, np.random.default_rng(2).normal(0, 1e-3, (8, 40)))
    r = fom.figures_of_merit(coef, 0.1, blanks, np.ones(40))
    assert r["sen"] == pytest.approx(1 / np.linalg.norm(coef), abs=1e-12) and r["loq"] > r["lod"] > 0 and r["sel"] == pytest.approx(1)
    assert np.allclose(fom.regression_vector(lambda x: x @ coef + 1, np.zeros(40)), coef)
    assert fom.sensitivity(np.zeros(3)) == math.inf
