import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.operators.guards import WATER_PARAMS, WaterParam
from specloom.operators.spectra import ShapeError
from specloom.plans import cards, river, serve, train
from specloom.sources import arff, tables
from specloom.streaming import control

from .test_spectral import AXIS, frame, mixture

CHAIN = [{"op": "savgol"}, {"op": "snv"}]
PARAM = WaterParam("TEST", (0.1, 0.3, 0.5, 1, 2), 0.02, 3, 0.15)


@pytest.fixture(scope="module")
def data(spark):
    x, y = mixture()
    return frame(spark, x, y, day_idx=[i // 12 for i in range(120)]).cache(), x, y


@pytest.fixture(scope="module")
def card(data):
    return train.train_model(data[0], list(AXIS), "TN", "pls", CHAIN, param=PARAM)


def test_training_is_accurate(data, card):
    plain = train.train_model(data[0], list(AXIS), "TN", "pls", [{"op": "savgol"}])  # scatter correction would hide the scale of this target
    assert plain.fom["rmse_cv"] < 0.05 * data[2].std() and 1 <= card.params["n_components"] <= 20
    assert card.describe()["fingerprint"] == card.fingerprint() and len(card.data_hash) == 16


@pytest.mark.parametrize("chain", [[], [{"op": "savgol"}], CHAIN, [{"op": "msc"}, {"op": "mean_center"}], [{"op": "whittaker", "lam": 5.0}, {"op": "column_scale"}]], ids=str)
def test_serving_matches_training(spark, data, chain, tmp_path):
    df, x, _ = data
    c = train.train_model(df, list(AXIS), "TN", "ridge", chain, param=PARAM)
    edge = serve.EdgeModel.compile(c)
    assert edge.verify(c, x) <= 1e-8
    edge.save(spark, str(tmp_path / "edge"))
    again = serve.EdgeModel.load(spark, str(tmp_path / "edge"))
    batch = np.array([r.prediction for r in serve.predict(c, df, list(AXIS)).orderBy("sample_id").collect()], float)
    table = np.array([r.prediction for r in again.score(df).orderBy("sample_id").collect()], float)
    assert cards.max_difference(batch, again.predict(x)) <= 1e-8 and cards.max_difference(batch, table) <= 1e-8


def test_cards_are_stored_whole(spark, data, card, tmp_path):
    cards.save_cards(spark, [card], str(tmp_path / "cards"))
    (again,) = cards.load_cards(spark, str(tmp_path / "cards"))
    assert again.fingerprint() == card.fingerprint() and again.coef == card.coef
    broken = json.loads(card.to_json()) | {"version": "2"}
    with pytest.raises(ValueError):
        cards.ModelCard.from_json(json.dumps(broken))


def test_shape_checks(data, card):
    with pytest.raises(ShapeError):
        serve.predict(card, data[0], list(AXIS[:-1]))
    with pytest.raises(ShapeError):
        serve.predict(card, data[0], list(AXIS + 1))
    with pytest.raises(Exception, match="channels expected"):
        serve.predict(card, data[0].withColumn("x", F.slice("x", 1, 5))).collect()


def test_cross_validation_schemes(data):
    df, x, y = data
    for cv, window in (("logo", None), ("expanding", None), ("rolling", 3)):
        splits = train.split_grams(df, cv, window=window)
        assert len(splits) == {"logo": 10, "expanding": 9, "rolling": 7}[cv]
    direct = []
    for tr, te in ((np.arange(120) < 12 * k, np.arange(120) // 12 == k) for k in range(1, 10)):
        a = np.column_stack([np.ones(tr.sum()), x[tr]])
        c = (x[tr] - x[tr].mean(0), y[tr] - y[tr].mean())
        b = np.linalg.solve(c[0].T @ c[0] + np.eye(101), c[0].T @ c[1])
        direct.append(np.sqrt(np.mean((y[te] - y[tr].mean() - (x[te] - x[tr].mean(0)) @ b) ** 2)))
        assert a.shape[1] == 102
    assert train.cv_rmse(train.split_grams(df, "expanding"), "ridge", {}) == pytest.approx(np.mean(direct), rel=1e-6)
    with pytest.raises(ValueError):
        train.split_grams(df, "rolling", window=50)


def test_candidates(spark, data):
    df, _, _ = data
    pool = train.sweep_grid(df, list(AXIS), "TN", ("pls", "ridge", "ols"), ([], CHAIN), param=PARAM, folds=4)
    assert len({c.model_type for c in pool}) == 6
    rows = train.score_cards(pool, df, PARAM).collect()
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows) and len(rows) == 6
    best = train.sweep(df, list(AXIS), "TN", ("pls", "lasso"), [], folds=4)
    assert best[0].fom["rmse_cv"] <= best[1].fom["rmse_cv"]
    fused, weights = serve.fuse(pool[:2], df, "equal")
    assert weights == [0.5, 0.5] and fused.count() == 120
    assert serve.fusion_weights([0.2, 0.4]) == pytest.approx([0.8, 0.2]) and serve.fusion_weights([0.2, float("nan")]) == pytest.approx([0.5, 0.5])
    with pytest.raises(ValueError):
        serve.fusion_weights([])


@pytest.mark.parametrize("key", ["krr", "rf", "gam"])
def test_other_models_serve(spark, data, key, tmp_path):
    c = train.train_model(data[0], list(AXIS), "TN", key, [], {"rf": {"numTrees": 5, "maxDepth": 3}}.get(key), folds=2)
    out = train.raw_predictions(c, data[0]).select("y", "y_pred").collect()
    assert np.corrcoef([r.y for r in out], [r.y_pred for r in out])[0, 1] > 0.5
    cards.save_cards(spark, [c], f"{tmp_path}/stored")
    (back,) = cards.load_cards(spark, f"{tmp_path}/stored")
    again = train.raw_predictions(back, data[0]).select("y_pred").collect()
    assert back.model_type == c.model_type and np.allclose([r.y_pred for r in again], [r.y_pred for r in out])


def test_guarded_prediction(data, card):
    out = serve.predict_with_guard(card, data[0], PARAM)
    assert {"prediction", "below_lod", "above_review", "not_display"} <= set(out.columns) and out.where("below_lod AND prediction <> 0.01").count() == 0


def test_preprocessing_report(spark, data):
    blanks = frame(spark, np.random.default_rng(0).normal(0, 1e-3, (8, 101)))
    r = train.evaluate_preprocessing(data[0], blanks, list(AXIS), [{"op": "savgol"}], model_params={"n_components": 3})
    assert r["s_x_after"] < r["s_x_before"] and r["sen"] > 0


def test_arff(spark, tmp_path):
    f = tmp_path / "a.arff"
    f.write_text("% c\n@relation r\n@attribute id numeric\n@attribute 'site name' string\n@attribute wavelength_210.5 real\n@attribute 205 numeric\n@attribute when string\n@data\n1,'a, b',0.5,0.25,2024-01-01 00:00:00\n2,c,?,1,bad\n")
    df, axis = arff.read_arff(spark, str(f), "ai", "when")
    rows = df.orderBy("id").collect()
    assert axis == [205.0, 210.5] and rows[0].x == [0.25, 0.5] and rows[0]["site name"] == "a, b" and rows[1].x == [1.0, None]
    assert rows[0].instrument_id == "ai" and rows[0].when.year == 2024 and rows[1].when is None
    assert [arff.wavelength(n) for n in ("200.0", "205nm", "wavelength_200.5", "site")] == [200.0, 205.0, 200.5, None]
    g = tmp_path / "b.arff"
    g.write_text("@relation r\n@data\n7,1,2,3,9\n")
    assert arff.read_positional(spark, str(g)).first()[:] == (7, [1.0, 2.0, 3.0])


def test_tables(spark, tmp_path):
    f = tmp_path / "w.csv"
    f.write_text("wavelength_2,wavelength_10,wavelength_1,DAY_idx,KMNO\n2,10,1,3,0.5\n4,,3,4,\n")
    df, axis = tables.read_wide_csv(spark, str(f), labels=("CODMn=KMNO",))
    assert axis == [190.0, 191.0, 199.0] and df.where("day_idx = 3").first().x == [1.0, 2.0, 10.0]
    assert tables.missing_counts(df).first()["CODMn"] == 1 and tables.missing_counts(df).first()["x"] == 1
    assert tables.parse_labels(["A=B", "C"]) == {"A": "B", "C": "C"}
    cfg = tmp_path / "p.yaml"
    cfg.write_text("params:\n  TN:\n    ranges: [0.2, 0.5]\n    lower_bound: 0.05\n")
    assert tables.load_params(str(cfg))["TN"].ranges == (0.2, 0.5)
    assert tables.params_table(spark, WATER_PARAMS).where("param = 'TN'").first().theoretical_upper == 10
    with pytest.raises(tables.ConfigError):
        tables.load_params(str(tmp_path / "none.yaml"))


def test_score_files(spark, tmp_path):
    base = {"r2_score": 0.9, "rmse": 0.1}
    mk = lambda rows: spark.createDataFrame([(m, v, base["r2_score"], base["rmse"]) for m, v in rows], "model_type string, mape double, r2_score double, rmse double")
    at = str(tmp_path / "scores")
    tables.write_scores(mk([("a", 0.2), ("b", 0.1)]), at)
    tables.write_scores(mk([("a", 0.15), ("b", 0.3), ("c", 0.4)]), at, merge=True)
    assert {r.model_type: r.mape for r in tables.read_scores(spark, at).collect()} == {"a": 0.15, "b": 0.1, "c": 0.4}


def test_river(spark):
    x, _ = mixture(6)
    df = frame(spark, x)
    assert all(len(r.x) == 101 for r in river.process_range(df).collect()) and all(len(r.x) == 3 for r in river.process_pca(df).collect())
    flat = [([0.0] * 101, v) for v in (10.0, 3.0, 0.001)]
    out = river.predict_branch(df, {"TUR": [flat[0]], "TN": [flat[2]], "AN": [flat[1]]}, {"TUR": [flat[0]]}).first()
    assert (out.TUR, out.TN, out.AN) == (10.0, 3.0, 3.0)
    constant = lambda v: [([0.0] * 101, v)]
    clear = {"TUR": constant(1.0), "KMNO": constant(2.0), "TN": constant(4.0)}
    wide = {"TUR": constant(50.0), "KMNO": constant(6.0), "TN": constant(5.0), "AN": constant(1.0)}
    turbid = river.predict_branch(df, clear, wide).first()
    assert (turbid.TUR, turbid.KMNO, turbid.TN) == (50.0, 6.0, 5.0)  # the wide set's turbidity decides
    still = wide | {"TUR": constant(10.0)}
    low, high = (df.withColumn("x", F.transform("x", lambda v: v * 0 + level)) for level in (0.5, 1.5))
    assert river.predict_branch(low, clear, still).first().KMNO == 2.0 and river.predict_branch(high, clear, still).first().KMNO == 6.0
    j = tables.result_json(spark.createDataFrame([(1, 7, 1.5)], "sample_id long, id long, TN double")).first()
    assert json.loads(j.json)["item"][0] == {"id": 7, "TN": 1.5}


def test_streamed_chart_equals_the_batch_loop(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 2}", i, float(rng.normal(5, 1))) for i in range(60)]
    src = str(tmp_path / "in")
    for k in range(3):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20], "series string, i long, value double")
        part.select("series", F.timestamp_seconds("i").alias("seq"), "value").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("series string, seq timestamp, value double").option("maxFilesPerTrigger", 1).parquet(src)
    q = control.control_chart(stream, 5.0, 1.0).writeStream.format("memory").queryName("charts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("charts").orderBy("series", "seq").collect()
    assert len(got) == 60
    for s in ("s0", "s1"):
        import pandas as pd

        own = [r for r in rows if r[0] == s]
        want, _ = control.advance(pd.DataFrame({"seq": [r[1] for r in own], "value": [r[2] for r in own]}), (0.0, 0.0, 5.0, 0), 5.0, 1.0, 0.5, 5.0, 0.2, 3.0)
        assert np.allclose([r.ewma for r in got if r.series == s], want["ewma"]) and np.allclose([r.c_pos for r in got if r.series == s], want["c_pos"])
