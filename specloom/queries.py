"""Queries over the test tables, with DuckDB twins where SQL can express them.

``embeddings`` stands in for spectra (channel j at 200 + 8 j nm, label as day or
group), ``events`` for time series, orders with their line items for pairs of
truth and prediction by day.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays, kernels
from .operators import acceptance, fom, gram, guards, hardware, hypothesis, linear, mspc, preprocess, scoring, sequences, spectra, transfer, unmixing
from .operators.guards import WATER_PARAMS, WaterParam

AXIS = [200.0 + 8 * j for j in range(64)]
ORDER_PARAM = WaterParam("ORDER", (50_000, 100_000, 150_000, 200_000, 250_000), 1000, 300_000, 5000)
TUR = WATER_PARAMS["TUR"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str, *meta: str) -> DataFrame:
    return spectra.spectra(table(spark, d, "embeddings"), "vec_id", "embedding", *meta)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(seq, day_idx, y_true, y_pred): an order's price and the sum of its items at full price."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y_pred"))
    o = table(spark, d, "orders")
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("int")
    return o.join(items, o.o_orderkey == items.l_orderkey).select(F.col("o_orderkey").alias("seq"), day.alias("day_idx"), F.col("o_totalprice").alias("y_true"), "y_pred")


def series(spark: SparkSession, d: str) -> DataFrame:
    seq = F.struct("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("series"), seq.alias("seq"), "event_id", "event_type", "ts", "value")


R = F.round
LONG = "long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS a FROM embeddings)"
STATS = "stats AS (SELECT vec_id, any_value(label) AS label, avg(a) AS m, stddev_pop(a) AS s FROM long GROUP BY vec_id)"
PRED = """pred AS (SELECT o_orderkey AS seq, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS day_idx, o_totalprice AS y_true, y_pred
    FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS y_pred FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def _class(v: str, ranges) -> str:
    return "(" + " + ".join(f"({v} >= {r})::INTEGER" for r in ranges) + ")"


# ---- spectra -----------------------------------------------------------------


@query(f"WITH {LONG}, {STATS} SELECT l.vec_id, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS sd, round(max((a - m) / s), 6) AS top FROM long l JOIN stats USING (vec_id) GROUP BY l.vec_id")
def snv_moments(spark, d):
    x = F.col("x")
    out = vectors(spark, d).select(F.col("sample_id").alias("vec_id"), arrays.mean(x).alias("mean"), arrays.sd(x).alias("sd"), preprocess.snv(x).alias("z"))
    return out.select("vec_id", R("mean", 6).alias("mean"), R("sd", 6).alias("sd"), R(F.array_max("z"), 6).alias("top"))


def tilted(spark: SparkSession, d: str, *meta: str) -> DataFrame:
    """The vectors on a rising baseline, so that every spectrum follows the mean one."""
    return vectors(spark, d, *meta).withColumn("x", F.transform("x", lambda v, j: v + j / 4.0))


TILTED = "long AS (SELECT vec_id, label, j, a + j / 4.0 AS a FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS a FROM embeddings))"


@query(f"WITH {TILTED}, ref AS (SELECT j, avg(a) AS r FROM long GROUP BY j), f AS (SELECT vec_id, regr_slope(a, r) AS b, regr_intercept(a, r) AS c FROM long JOIN ref USING (j) GROUP BY vec_id) SELECT vec_id, j::INTEGER AS j, round((a - c) / b, 5) AS value FROM long JOIN f USING (vec_id)")
def msc(spark, d):
    df = tilted(spark, d)
    out = preprocess.fit([{"op": "msc"}], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("x").alias("j", "a")).select("vec_id", "j", R("a", 5).alias("value"))


@query(f"WITH {LONG}, ref AS (SELECT j, avg(a) AS m, stddev_pop(a) AS s FROM long GROUP BY j) SELECT vec_id, round(sum((a - m) / s), 5) AS total, round(max((a - m) / s), 5) AS top FROM long JOIN ref USING (j) GROUP BY vec_id")
def column_scale(spark, d):
    df = vectors(spark, d)
    out = preprocess.fit([{"op": "column_scale"}], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), R(arrays.total(F.col("x")), 5).alias("total"), R(F.array_max("x"), 5).alias("top"))


@query(f"WITH {LONG}, ref AS (SELECT j, avg(a) AS m FROM long GROUP BY j) SELECT vec_id, round(sum(a - m), 5) AS total, round(min(a - m), 5) AS low FROM long JOIN ref USING (j) GROUP BY vec_id")
def mean_center(spark, d):
    df = vectors(spark, d)
    out = preprocess.fit([{"op": "mean_center"}], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), R(arrays.total(F.col("x")), 5).alias("total"), R(F.array_min("x"), 5).alias("low"))


def polynomial_matrix(p: int, window: int, order: int, deriv: int = 0) -> str:
    """SQL rows (i, j, w) of a smoothing polynomial, edges by the end windows, from fits to unit vectors."""
    half, rows = window // 2, []
    units = [np.poly1d(np.polyfit(np.arange(-half, half + 1.0), u, order)).deriv(deriv) for u in np.eye(window)]
    for i in range(p):
        centre = min(max(i, half), p - 1 - half)
        rows += [(i, centre - half + k, float(u(i - centre))) for k, u in enumerate(units)]
    return "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {v!r}::DOUBLE)" for i, j, v in rows) + ") AS t(i, j, w))"


def _filtered(spark, d, step: dict, digits: int = 6) -> DataFrame:
    df = vectors(spark, d)
    out = preprocess.fit([step], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), F.posexplode("x").alias("j", "a")).select("vec_id", "j", R("a", digits).alias("value"))


def _filter_sql(window: int, order: int, deriv: int = 0) -> str:
    return f"WITH {LONG}, {polynomial_matrix(64, window, order, deriv)} SELECT vec_id, i::INTEGER AS j, round(sum(a * w), 6) AS value FROM long JOIN w USING (j) GROUP BY vec_id, i"


@query(_filter_sql(11, 3))
def savgol(spark, d):
    return _filtered(spark, d, {"op": "savgol", "window": 11, "polyorder": 3})


@query(_filter_sql(9, 2, 1))
def deriv_gram(spark, d):
    return _filtered(spark, d, {"op": "deriv_gram", "window": 9, "order": 2, "der": 1})


@query(f"WITH {LONG}, {polynomial_matrix(64, 11, 3)}, s AS (SELECT vec_id, i, sum(a * w) AS a FROM long JOIN w USING (j) GROUP BY vec_id, i), m AS (SELECT vec_id, avg(a) AS m, stddev_pop(a) AS s FROM s GROUP BY vec_id) SELECT vec_id, round(max((a - m) / s), 5) AS top, round(min((a - m) / s), 5) AS low FROM s JOIN m USING (vec_id) GROUP BY vec_id")
def savgol_snv(spark, d):
    df = vectors(spark, d)
    out = preprocess.fit([{"op": "savgol", "window": 11}, {"op": "snv"}], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), R(F.array_max("x"), 5).alias("top"), R(F.array_min("x"), 5).alias("low"))


@query(f"WITH {LONG}, g AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM long) SELECT vec_id, round(sum((a - m) / s), 5) AS total, round(max((a - m) / s), 5) AS top FROM long, g GROUP BY vec_id")
def global_standardize(spark, d):
    out = preprocess.global_standardize(vectors(spark, d))
    return out.select(F.col("sample_id").alias("vec_id"), R(arrays.total(F.col("x")), 5).alias("total"), R(F.array_max("x"), 5).alias("top"))


@query(f"WITH {LONG} SELECT vec_id, count(*)::INTEGER AS n, round(sum(a), 5) AS total, round(sum(CASE WHEN j BETWEEN 10 AND 53 THEN a END), 5) AS trimmed FROM long WHERE 200 + 8 * j BETWEEN 240 AND 648 GROUP BY vec_id")
def clip_and_trim(spark, d):
    df = vectors(spark, d)
    cut, axis = spectra.clip_wavelengths(df, AXIS, 240, 648)
    trimmed, _ = spectra.trim_bands(df, AXIS, 10)
    cut = cut.select("sample_id", F.size("x").alias("n"), arrays.total(F.col("x")).alias("t"))
    # j 10 to 53 also lies inside the clipped band, so both come from the same spectra.
    both = cut.join(trimmed.select("sample_id", arrays.total(F.col("x")).alias("u")), "sample_id")
    return both.select(F.col("sample_id").alias("vec_id"), "n", R("t", 5).alias("total"), R("u", 5).alias("trimmed"))


@query(f"WITH {LONG} SELECT label, j::INTEGER AS j, count(a) AS n, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd_pop FROM long GROUP BY label, j")
def channel_stats(spark, d):
    out = gram.long_stats(vectors(spark, d, "label"), "label")
    return out.select("label", "j", "n", R("mean", 6).alias("mean"), R("sd_pop", 6).alias("sd_pop"))


@query(f"WITH {LONG}, t AS (SELECT j, stddev_samp(a) AS s, avg(a) AS m FROM long GROUP BY j) SELECT round(max(s), 6) AS dark_noise_max, round(avg(s), 6) AS dark_noise_mean, round(max(s), 6) AS baseline_flatness, round(max(abs(m - 0.25)), 6) AS baseline_deviation_max, round(avg(m) / avg(s), 5) AS snr FROM t")
def repeat_figures(spark, d):
    df = vectors(spark, d)
    both = hardware.dark_noise(df).crossJoin(hardware.baseline_flatness(df, 0.25))
    return both.select(*[R(c, 6).alias(c) for c in both.columns], R(F.lit(hardware.signal_to_noise(df)), 5).alias("snr"))


@query(f"WITH {LONG}, t AS (SELECT j, stddev_samp(a) AS s FROM long GROUP BY j), m AS (SELECT 'dark_noise_max' AS metric, max(s) AS value, 0.001 AS most FROM t UNION ALL SELECT 'dark_noise_mean', avg(s), 0.001 FROM t UNION ALL SELECT 'baseline_flatness', max(s), 0.002 FROM t) SELECT metric, round(value, 6) AS value, value <= most AS passed FROM m")
def instrument_report(spark, d):
    df = vectors(spark, d)
    out = hardware.evaluate_instrument(AXIS, dark=df, blank=df)
    rows = [(k, round(float(out["metrics"][k]), 6), bool(v)) for k, v in out["passed"].items()]
    return spark.createDataFrame(rows, "metric string, value double, passed boolean")


@query(f"""WITH {LONG}, n AS (SELECT vec_id, j, a, lag(a) OVER w AS l, lead(a) OVER w AS r FROM long WINDOW w AS (PARTITION BY vec_id ORDER BY j)),
    p AS (SELECT vec_id, around, arg_max(struct_pack(j := j, a := a, l := l, r := r), struct_pack(a := a, j := -j)) AS p
          FROM n, unnest([300.0::DOUBLE, 450.0, 600.0]) v(around) WHERE abs(200 + 8 * j - around) <= 30 GROUP BY vec_id, around)
    SELECT vec_id, around, round(CASE WHEN p.l - 2 * p.a + p.r < 0 AND abs(0.5 * (p.l - p.r) / (p.l - 2 * p.a + p.r)) <= 1
           THEN 200 + 8 * p.j + 8 * 0.5 * (p.l - p.r) / (p.l - 2 * p.a + p.r) ELSE 200 + 8 * p.j END, 5) AS nm FROM p""")
def peak_wavelength(spark, d):
    out = hardware.peaks(spectra.to_long(vectors(spark, d), AXIS), (300.0, 450.0, 600.0), 30.0)
    return out.select(F.col("sample_id").alias("vec_id"), "around", R("nm", 5).alias("nm"))


@query(f"WITH p AS ({ORACLES['peak_wavelength'].replace('round(CASE', '(CASE').replace('END, 5)', 'END)')}) SELECT vec_id, round(max(abs(nm - around)), 4) AS worst FROM p GROUP BY vec_id")
def wavelength_accuracy(spark, d):
    out = hardware.wavelength_accuracy(spectra.to_long(vectors(spark, d), AXIS), (300.0, 450.0, 600.0), 30.0)
    return out.select(F.col("sample_id").alias("vec_id"), R("wavelength_accuracy", 4).alias("worst"))


@query(f"""WITH {LONG}, m AS (SELECT j, avg(a) AS a FROM long GROUP BY j), q AS (SELECT unnest([150.0::DOUBLE, 203.0, 333.3, 704.0, 900.0]) AS nm)
    SELECT nm, round(CASE WHEN nm <= 200 THEN (SELECT a FROM m WHERE j = 0) WHEN nm >= 704 THEN (SELECT a FROM m WHERE j = 63)
      ELSE (SELECT l.a + (nm - 200 - 8 * l.j) / 8 * (r.a - l.a) FROM m l JOIN m r ON r.j = l.j + 1 WHERE l.j = floor((nm - 200) / 8)) END, 6) AS value FROM q""")
def interpolated(spark, d):
    mean, _ = gram.column_stats(vectors(spark, d))
    points = [150.0, 203.0, 333.3, 704.0, 900.0]
    rows = [(nm, round(float(v), 6)) for nm, v in zip(points, hardware.interpolate(AXIS, mean, points))]
    return spark.createDataFrame(rows, "nm double, value double")


@query(f"WITH {LONG}, m AS (SELECT j, avg(a) AS a FROM long GROUP BY j) SELECT round(max(abs(a - CASE j WHEN 5 THEN 0.1 WHEN 25 THEN 0.2 END)), 6) AS photometric, round(max(CASE WHEN j IN (5, 25, 60) THEN a END), 6) AS stray FROM m")
def photometric(spark, d):
    mean, _ = gram.column_stats(vectors(spark, d))
    p = hardware.photometric_accuracy(AXIS, mean, [(240.0, 0.1), (400.0, 0.2)])
    s = hardware.stray_light(AXIS, mean, [240.0, 400.0, 680.0])
    return spark.createDataFrame([(round(p, 6), round(s, 6))], "photometric double, stray double")


@query(f"""WITH {LONG} SELECT j::INTEGER AS j, vec_id AS concentration, round(regr_r2(vec_id, a) OVER (PARTITION BY j ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 5) AS r2
    FROM long QUALIFY row_number() OVER (PARTITION BY j ORDER BY vec_id) > 2""")
def linearity_r2(spark, d):
    df = vectors(spark, d).select(F.col("sample_id").alias("concentration"), "x")
    return hardware.linearity(df, 64, window=1, order=3).where("k > 2").select("j", "concentration", R("r2", 5).alias("r2"))


@query(f"""WITH {LONG}, {polynomial_matrix(64, 15, 3)}, s AS (SELECT vec_id, i AS j, sum(a * w) AS a FROM long JOIN w USING (j) GROUP BY vec_id, i)
    SELECT j::INTEGER AS j, vec_id AS concentration, round(regr_r2(vec_id, a) OVER (PARTITION BY j ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 5) AS r2
    FROM s QUALIFY row_number() OVER (PARTITION BY j ORDER BY vec_id) > 2""")
def linearity_all(spark, d):
    """The same, smoothed as by default."""
    df = vectors(spark, d).select(F.col("sample_id").alias("concentration"), "x")
    return hardware.linearity(df, 64).where("k > 2").select("j", "concentration", R("r2", 5).alias("r2"))


# ---- transfer ------------------------------------------------------------------

PAIRS = "long2 AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS std_id, embedding FROM embeddings), p AS (SELECT s.std_id, generate_subscripts(s.embedding, 1) - 1 AS j, unnest(s.embedding)::DOUBLE AS s, unnest(m.embedding)::DOUBLE AS m FROM long2 s JOIN long2 m USING (std_id) WHERE s.label = 0 AND m.label = 1)"


def standards(spark, d) -> tuple[DataFrame, DataFrame]:
    n = vectors(spark, d, "label").where("label IN (0, 1)").withColumn("std_id", F.row_number().over(Window.partitionBy("label").orderBy("sample_id")))
    return n.where("label = 0"), n.where("label = 1")


@query(f"WITH {PAIRS} SELECT j::INTEGER AS j, round(regr_slope(m, s), 5) AS gain, round(regr_intercept(m, s), 5) AS gain_offset FROM p GROUP BY j")
def gain_offset(spark, d):
    out = transfer.gain_offset(transfer.pairs(*standards(spark, d)))
    return out.select("j", R("gain", 5).alias("gain"), R("offset", 5).alias("gain_offset"))


@query(f"WITH {LONG} SELECT j::INTEGER AS j, round(avg(CASE WHEN label = 1 THEN a END) - avg(CASE WHEN label = 0 THEN a END), 6) AS residual FROM long GROUP BY j")
def residual_spectrum(spark, d):
    return transfer.residual_spectrum(*standards(spark, d)).select("j", R("residual", 6).alias("residual"))


@query(f"WITH {PAIRS} SELECT j::INTEGER AS j, round(stddev_pop(m) / stddev_pop(s), 5) AS scale, round(avg(m) - stddev_pop(m) / stddev_pop(s) * avg(s), 5) AS shift FROM p GROUP BY j")
def meanvar(spark, d):
    a = transfer.mean_variance(transfer.pairs(*standards(spark, d)))
    rows = [(j, float(a.scale[j]), float(a.shift[j])) for j in range(64)]
    return spark.createDataFrame(rows, "j int, scale double, shift double").select("j", R("scale", 5).alias("scale"), R("shift", 5).alias("shift"))


@query(f"WITH {PRED} SELECT round(regr_slope(y_true, y_pred), 6) AS slope, round(regr_intercept(y_true, y_pred), 4) AS intercept FROM pred")
def sbc_fit(spark, d):
    slope, intercept = transfer.slope_bias(predictions(spark, d), "y_pred", "y_true")
    return spark.createDataFrame([(round(slope, 6), round(intercept, 4))], "slope double, intercept double")


@query(f"WITH {PAIRS} SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.s * b.m), 3) AS v FROM p a JOIN p b USING (std_id) GROUP BY a.j, b.j")
def direct_standardization(spark, d):
    """(S'S + r I) F for the fitted F: the normal equations make it S'M."""
    p = transfer.pairs(*standards(spark, d))
    f = transfer.direct(p, ridge=1e-3).matrix[1:]
    s = gram.gram(p.select(F.col("s").alias("x")), y=None).m[1:-1, 1:-1]
    return _cells(spark, (s + 1e-3 * np.eye(64)) @ f, 3)


def _cells(spark, m: np.ndarray, digits: int) -> DataFrame:
    rows = [(i, j, round(float(v), digits) + 0.0) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "i int, j int, v double")


@query(f"WITH {PAIRS}, u AS (SELECT std_id, j, s FROM p UNION ALL SELECT std_id, -1, 1 FROM p GROUP BY std_id) SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.s * b.m), 3) AS v FROM u a JOIN p b USING (std_id) WHERE a.j = -1 OR abs(a.j - b.j) <= 2 GROUP BY a.j, b.j")
def piecewise_standardization(spark, d):
    """Each channel's band of normal equations, the intercept as channel -1."""
    p = transfer.pairs(*standards(spark, d))
    f = transfer.piecewise(p, 2, 1e-3).matrix
    g = gram.gram(p.select(F.col("s").alias("x")), y=None).m[:-1, :-1]
    rows = []
    for j in range(64):
        on = np.concatenate([[0], np.arange(max(0, j - 2), min(64, j + 3)) + 1])
        left = (g[np.ix_(on, on)] + 1e-3 * np.eye(len(on))) @ f[on, j]
        rows += [(int(i) - 1, j, round(float(v), 3) + 0.0) for i, v in zip(on, left)]
    return spark.createDataFrame(rows, "i int, j int, v double")


@query(f"WITH {PAIRS}, c AS (SELECT a.j AS i, b.j AS j, avg((a.s - a.m) * (b.s - b.m)) AS v FROM p a JOIN p b USING (std_id) GROUP BY a.j, b.j), t AS (SELECT sum(v) / 64 AS t FROM c WHERE i = j) SELECT i::INTEGER AS i, j::INTEGER AS j, round(v / t, 4) AS v FROM c, t")
def glsw_weighting(spark, d):
    """W^-2 - lam I for the fitted W: the scaled cross product of the differences."""
    w = transfer.weighting(transfer.pairs(*standards(spark, d)), 1e-3).matrix[1:]
    return _cells(spark, np.linalg.inv(w @ w) - 1e-3 * np.eye(64), 4)


def _spread_sql(picks: int) -> str:
    """Maximally spread rows, one step after another."""
    far = "list_sum(list_transform(list_zip(n.e, p.e), lambda z: (z[1] - z[2]) ** 2))"
    steps = ["n0 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
             f"d0 AS (SELECT n.vec_id, sum({far}) AS d FROM n0 n, n0 p GROUP BY n.vec_id)",
             "p1 AS (SELECT vec_id, e FROM n0 JOIN d0 USING (vec_id) ORDER BY d DESC, vec_id LIMIT 1)",
             f"n1 AS (SELECT n.vec_id, n.e, {far} AS d FROM n0 n, p1 p)"]
    for k in range(2, picks + 1):
        steps.append(f"p{k} AS (SELECT vec_id, e FROM n{k - 1} ORDER BY d DESC, vec_id LIMIT 1)")
        steps.append(f"n{k} AS (SELECT n.vec_id, n.e, least(n.d, {far}) AS d FROM n{k - 1} n, p{k} p)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT vec_id FROM p{k}" for k in range(1, picks + 1))


@query(_spread_sql(8))
def kennard_stone(spark, d):
    keys = transfer.kennard_stone(vectors(spark, d), 8)
    return spark.createDataFrame([(int(k),) for k in keys], "vec_id long")


@query(f"""WITH {LONG}, m AS (SELECT label, j, avg(a) AS a FROM long WHERE label IN (0, 1) GROUP BY label, j), c AS (SELECT label, j, a - avg(a) OVER (PARTITION BY label) AS a FROM m),
    g AS (SELECT lag, sum(s.a * m.a) / sqrt(sum(s.a * s.a)) AS cosine FROM c s, unnest([-3, -2, -1, 0, 1, 2, 3]) l(lag), c m WHERE s.label = 0 AND m.label = 1 AND m.j = s.j + lag GROUP BY lag)
    SELECT lag * 8.0::DOUBLE AS shift FROM g ORDER BY cosine DESC, lag LIMIT 1""")
def wavelength_shift(spark, d):
    return spark.createDataFrame([(transfer.wavelength_shift(AXIS, *standards(spark, d), 24.0),)], "shift double")


@query("SELECT label, CASE WHEN n < 5 THEN 'sbc' WHEN label > 4 THEN 'align_then_pds' WHEN n >= 64 THEN 'ds' ELSE 'pds' END AS method, CASE WHEN n >= 5 AND (label > 4 OR n < 64) THEN 5 END AS pds_window FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def transfer_advice(spark, d):
    """For the count of each label, with a shift of an eighth of the label in nm."""
    counts = table(spark, d, "embeddings").groupBy("label").count().collect()
    found = [(int(r["label"]), transfer.recommend(AXIS, r["label"] / 8, r["count"])) for r in counts]
    return spark.createDataFrame([(k, v["method"], v["window"]) for k, v in found], "label int, method string, pds_window int")


# ---- predictions ---------------------------------------------------------------


@query(f"WITH {PRED}, c AS (SELECT {_class('y_true', ORDER_PARAM.ranges)} AS t, {_class('y_pred', ORDER_PARAM.ranges)} AS p FROM pred) SELECT g.t AS true_class, h.p AS pred_class, count(c.t) AS n FROM (SELECT unnest(range(6))::INTEGER AS t) g CROSS JOIN (SELECT unnest(range(6))::INTEGER AS p) h LEFT JOIN c ON c.t = g.t AND c.p = h.p GROUP BY g.t, h.p")
def class_confusion(spark, d):
    return acceptance.confusion(predictions(spark, d), ORDER_PARAM)


@query("SELECT event_id, CASE WHEN value < 0.3 THEN 0.15 WHEN value > 2000 THEN NULL ELSE value END AS value, value < 0.3 AS below, value > 150 AND value <= 2000 AS above, value > 2000 AS over, (value >= 30)::INTEGER + (value >= 50)::INTEGER + (value >= 1000)::INTEGER AS class FROM events")
def bounds_flags(spark, d):
    b = guards.bounds(F.col("value"), TUR.lower_bound, TUR.review_upper, TUR.theoretical_upper())
    cols = [c.alias(k) for k, c in b.items()]
    return table(spark, d, "events").select("event_id", *cols, guards.water_class(F.col("value"), TUR.ranges).alias("class"))


_OK = "CASE WHEN y_true <= 100000 AND y_pred <= 100000 THEN true WHEN y_true <= 100000 THEN abs(y_pred - y_true) / abs(y_true) <= 0.4 WHEN y_true <= 200000 THEN abs(y_pred - y_true) / abs(y_true) <= 0.3 WHEN y_true > 250000 THEN abs(y_pred - y_true) / abs(y_true) <= 0.2 ELSE abs(y_pred - y_true) <= 5000 END"


@query(f"WITH {PRED} SELECT day_idx, count(*) AS n, round(avg(({_OK})::INTEGER), 6) AS acceptance, round(CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END, 4) AS r2 FROM pred GROUP BY day_idx HAVING count(*) >= 2")
def acceptance_by_day(spark, d):
    p = predictions(spark, d)
    out = acceptance.daily_r2(p).join(acceptance.acceptance_rate(p, ORDER_PARAM, "day_idx"), "day_idx")
    return out.select("day_idx", "n", R("acceptance", 6).alias("acceptance"), R("r2", 4).alias("r2"))


@query(f"WITH {PRED} SELECT count(*) AS n, round(sqrt(avg((y_pred - y_true) ** 2)), 3) AS rmse, round(avg(abs(y_pred - y_true)), 3) AS mae, round(avg(y_pred - y_true), 3) AS bias, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 5) AS r2, round(avg(CASE WHEN y_true <> 0 THEN abs((y_pred - y_true) / y_true) END), 5) AS mape, round(avg(({_OK})::INTEGER), 6) AS acceptance FROM pred")
def acceptance_report(spark, d):
    r = acceptance.acceptance_report(predictions(spark, d), ORDER_PARAM)["errors"]
    return r.select("n", *[R(c, k).alias(c) for c, k in (("rmse", 3), ("mae", 3), ("bias", 3), ("r2", 5), ("mape", 5), ("acceptance", 6))])


ALARM = "SELECT user_id, round(avg((t = p)::INTEGER), 6) AS accuracy, round(coalesce(sum((p AND NOT t)::INTEGER) / nullif(sum((NOT t)::INTEGER), 0), 0), 6) AS false_alarm, round(coalesce(sum((t AND NOT p)::INTEGER) / nullif(sum(t::INTEGER), 0), 0), 6) AS missed_alarm, count_if(t AND p)::BIGINT AS tp, count_if(p AND NOT t)::BIGINT AS fp, count_if(t AND NOT p)::BIGINT AS fn, count_if(NOT t AND NOT p)::BIGINT AS tn FROM (SELECT user_id, value >= 150 AS t, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 150 AS p FROM events) WHERE p IS NOT NULL GROUP BY user_id"


@query(ALARM)
def alarm_confusion(spark, d):
    w = Window.partitionBy("series").orderBy("seq")
    p = series(spark, d).select(F.col("series").alias("user_id"), F.col("value").alias("y_true"), F.lag("value").over(w).alias("y_pred"))
    out = acceptance.alarm(acceptance.finite(p), 150.0, "user_id")
    return out.select("user_id", *[R(c, 6).alias(c) for c in ("accuracy", "false_alarm", "missed_alarm")], "tp", "fp", "fn", "tn")


SCORED = """p AS (SELECT event_type AS model_type, ts, event_id, value AS t, lag(value, 1, value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
    e AS (SELECT *, p - t AS e, date_diff('day', DATE '2020-01-01', ts::DATE) AS day_idx FROM p),
    l AS (SELECT *, lag(e) OVER (PARTITION BY model_type ORDER BY ts, event_id) AS before FROM e),
    d AS (SELECT model_type, avg(r2) AS daily_r2_score, avg(r) AS daily_pearson_r_score FROM (SELECT model_type, day_idx, CASE WHEN var_pop(t) > 0 THEN 1 - sum(e * e) / (var_pop(t) * count(*)) END AS r2, CASE WHEN var_pop(t) > 0 AND var_pop(p) > 0 THEN corr(t, p) END AS r FROM e GROUP BY model_type, day_idx HAVING count(*) >= 2) GROUP BY model_type),
    m AS (SELECT model_type, avg(((t >= 1000) = (p >= 1000))::INTEGER) AS alarm_acc, 1 - avg(((t >= 1000) = (p >= 1000))::INTEGER) AS alarm_err, avg(abs(e) / t) AS mape,
      avg((CASE WHEN t <= 50 AND p <= 50 THEN true WHEN t <= 50 THEN abs(e) / greatest(abs(t), 1e-12) <= 0.4 WHEN t > 1000 THEN abs(e) / t <= 0.2 ELSE abs(e) <= 5 END)::INTEGER) AS rate, 1 - sum(e * e) / (var_pop(t) * count(*)) AS r2_score, corr(t, p) AS pearson, sqrt(avg(e * e)) AS rmse,
      greatest(0, least(1, 1 - (sum((before IS NOT NULL AND sign(e) <> sign(before))::INTEGER) + 1) / ((count(*) + 1) / 2))) AS grouped, sum((e - before) ** 2) / sum(e * e) AS dw,
      avg((e - mu) ** 4) / avg((e - mu) ** 2) ** 2 - 3 AS kurt, avg((e - mu) ** 3) / avg((e - mu) ** 2) ** 1.5 AS sk FROM (SELECT *, avg(e) OVER (PARTITION BY model_type) AS mu FROM l) GROUP BY model_type)"""


def event_predictions(spark, d) -> DataFrame:
    """Each event's value predicted by the one before it of its type, the first by itself; unknown times and ids come last."""
    late = [F.col(c).isNull().alias(f"no_{c}") for c in ("ts", "event_id")]
    s = series(spark, d).withColumn("seq", F.struct(late[0], "ts", late[1], "event_id"))
    w = Window.partitionBy("event_type").orderBy("seq")
    pred = F.when(F.row_number().over(w) == 1, F.col("value")).otherwise(F.lag("value").over(w))
    return s.select(F.col("event_type").alias("model_type"), "seq", F.datediff("ts", F.lit("2020-01-01")).alias("day_idx"), F.col("value").alias("y_true"), pred.alias("y_pred"))


def event_scores(spark, d) -> DataFrame:
    """Their scores by the SQL's formulae."""
    return scoring.score_rows(event_predictions(spark, d), TUR, plain=True)


def half_away(c, digits: int):
    """Rounded as the SQL does it: the scaled double, halves away from zero, small negatives to -0.0."""
    v = F.round(F.abs(c) * 10.0**digits, 0) / 10.0**digits
    return F.when(c < 0, -v).otherwise(v)


_SHORT = {"alarm_acc": "alarm_acc", "alarm_err": "alarm_err", "mape": "mape", "r2_score": "r2_score", "pearson_r_score": "pearson", "daily_r2_score": "daily_r2_score", "daily_pearson_r_score": "daily_pearson_r_score", "rmse": "rmse", "rate of reaching the standard": "rate", "bad grouped ratio": "grouped", "durbin_watson_value": "dw", "Kurtosis": "kurt", "skew": "sk"}


@query(f"WITH {SCORED} SELECT model_type, {', '.join(f'round({c}, 5) AS {c}' for c in _SHORT.values())} FROM m JOIN d USING (model_type)")
def score_rows(spark, d):
    out = event_scores(spark, d)
    return out.select("model_type", *[half_away(F.col(f"`{k}`"), 5).alias(v) for k, v in _SHORT.items()])


def _rank_sql() -> str:
    """All ten component ranks added up."""
    ordinal = lambda c, way: f"row_number() OVER (ORDER BY {c} {way} NULLS LAST, model_type) - 1"
    shared = lambda c, way: f"rank() OVER (ORDER BY {c} {way} NULLS LAST) - 1"
    leveraged = lambda c: f"{ordinal(c, 'DESC')} + CASE WHEN {c} < 0 THEN (count(*) OVER () - 1) * -{c} / (1 - {c}) ELSE 0 END"
    parts = [ordinal("alarm_acc", "DESC"), ordinal("alarm_err", "ASC"), shared("mape", "ASC"), leveraged("r2_score"), leveraged("daily_r2_score"), ordinal("daily_pearson_r_score", "DESC"), shared("rmse", "ASC"), shared("rate", "DESC"), shared("grouped", "ASC"), shared("abs(dw - 2)", "ASC")]
    return f"r AS (SELECT model_type, {' + '.join(parts)} AS rank FROM m JOIN d USING (model_type))"


@query(f"WITH {SCORED}, {_rank_sql()} SELECT model_type, round(rank, 5) AS rank FROM r")
def rank_components(spark, d):
    return scoring.rank_models(event_scores(spark, d)).select("model_type", R("rank", 5).alias("rank"))


@query(f"WITH {SCORED}, {_rank_sql()} SELECT model_type, round(rank, 5) AS rank FROM r ORDER BY r.rank, model_type LIMIT 3")
def top_models(spark, d):
    ranked = scoring.rank_models(event_scores(spark, d))
    return scoring.select_top_k(ranked, 3).select("model_type", R("rank", 5).alias("rank"))


@query("""WITH o AS (SELECT event_type AS model_type, min(value) AS mape, max(value) AS rmse FROM events WHERE event_type <> 'click' GROUP BY event_type),
    n AS (SELECT event_type AS model_type, avg(value) - 40 AS mape, avg(value) AS rmse FROM events WHERE event_type <> 'view' GROUP BY event_type)
    SELECT coalesce(o.model_type, n.model_type) AS model_type, round(CASE WHEN o.model_type IS NULL OR n.mape < o.mape THEN n.mape ELSE o.mape END, 5) AS mape,
      round(CASE WHEN o.model_type IS NULL OR n.mape < o.mape THEN n.rmse ELSE o.rmse END, 5) AS rmse FROM o FULL JOIN n ON o.model_type = n.model_type""")
def upsert_scores(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "model_type")
    old = e.where("model_type <> 'click'").groupBy("model_type").agg(F.min("value").alias("mape"), F.max("value").alias("rmse"))
    new = e.where("model_type <> 'view'").groupBy("model_type").agg((F.avg("value") - 40).alias("mape"), F.avg("value").alias("rmse"))
    return scoring.upsert_scores(old, new).select("model_type", R("mape", 5).alias("mape"), R("rmse", 5).alias("rmse"))


@query(f"""WITH {LONG} SELECT vec_id, round(CASE WHEN f < 0.1 THEN 0.05 ELSE f END, 6) AS fused
    FROM (SELECT vec_id, sum(CASE j WHEN 5 THEN a / 0.04 WHEN 20 THEN a / 0.16 END) / (1 / 0.04 + 1 / 0.16) AS f FROM long GROUP BY vec_id)""")
def fuse_weighted(spark, d):
    from .plans.serve import fuse

    members = [card([1.0 if j == at else 0.0 for j in range(64)], 0.0, rmse_cv=rmse) for at, rmse in ((5, 0.2), (20, 0.4))]
    out, _ = fuse(members, vectors(spark, d), param=WaterParam("F", (1.0,), 0.1))
    return out.select(F.col("sample_id").alias("vec_id"), R("fused", 6).alias("fused"))


def card(coef: list[float], intercept: float, chain=(), df: DataFrame | None = None, **fom):
    """A model card with given coefficients."""
    from .plans.cards import ModelCard

    fitted = preprocess.fit(list(chain), df, 64)
    return ModelCard("ols", "y", fitted.steps, {"steps": fitted.steps, "p": 64, "state": fitted.state}, AXIS, coef, intercept, fom=fom)


# ---- series --------------------------------------------------------------------


@query("""WITH z AS (SELECT user_id, ts, event_id, (value - avg(value) OVER u) / stddev_samp(value) OVER u AS z, row_number() OVER w AS i FROM events WINDOW u AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN i > 1 THEN z - 0.5 ELSE 0 END) OVER w AS s, sum(CASE WHEN i > 1 THEN z + 0.5 ELSE 0 END) OVER w AS t FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, round(s - min(s) OVER w, 6) AS c_pos, round(t - max(t) OVER w, 6) AS c_neg, s - min(s) OVER w > 5 OR t - max(t) OVER w < -5 AS alarm FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cusum(spark, d):
    out = sequences.cusum(series(spark, d))
    return out.select(F.col("seq.event_id").alias("event_id"), R("c_pos", 6).alias("c_pos"), R("c_neg", 6).alias("c_neg"), "alarm")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id) AS m, coalesce(stddev_samp(value) OVER (PARTITION BY user_id), 0) AS sd, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, m, sd, 0.2::DOUBLE * value + 0.8::DOUBLE * m AS z FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, s.m, s.sd, 0.2::DOUBLE * s.value + 0.8::DOUBLE * r.z FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1),
    h AS (SELECT *, 3 * sd * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * i))) AS h FROM r)
    SELECT event_id, round(z, 5) AS ewma, round(m - h, 4) AS lcl, round(m + h, 4) AS ucl, abs(z - m) > h AS alarm FROM h""")
def ewma(spark, d):
    out = sequences.ewma(series(spark, d))
    return out.select(F.col("seq.event_id").alias("event_id"), R("ewma", 5).alias("ewma"), R("lcl", 4).alias("lcl"), R("ucl", 4).alias("ucl"), "alarm")


@query("""WITH c AS (SELECT user_id, value, value - avg(value) OVER (PARTITION BY user_id) AS c, ts, event_id FROM events), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM c),
    g AS (SELECT user_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, greatest(-0.99, least(0.99, sum(c * l) / sum(c * c))) AS rho FROM l GROUP BY user_id)
    SELECT user_id, round(m, 5) AS center, round(m - 3 * sd / sqrt(CASE WHEN n < 3 THEN n ELSE greatest(1, n * (1 - rho) / (1 + rho)) END), 4) AS lcl, round(m + 3 * sd / sqrt(CASE WHEN n < 3 THEN n ELSE greatest(1, n * (1 - rho) / (1 + rho)) END), 4) AS ucl FROM g""")
def shewhart(spark, d):
    out = sequences.shewhart_limits(series(spark, d))
    return out.select(F.col("series").alias("user_id"), R("center", 5).alias("center"), R("lcl", 4).alias("lcl"), R("ucl", 4).alias("ucl"))


@query("""WITH p AS (SELECT user_id, arg_min(i, struct_pack(v := -value, i := i)) AS peak FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) GROUP BY user_id),
    s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, CASE WHEN i <= peak THEN max(value) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) ELSE max(CASE WHEN i > peak THEN value END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS value FROM s JOIN p USING (user_id)""")
def unimodal(spark, d):
    out = sequences.unimodal(series(spark, d))
    return out.select(F.col("seq.event_id").alias("event_id"), "value")


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), k AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE value >= 100)
    SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM k GROUP BY user_id, g""")
def alarm_runs(spark, d):
    flat = series(spark, d).select("series", F.row_number().over(Window.partitionBy("series").orderBy("seq")).cast("long").alias("seq"), "value")
    return sequences.islands(flat, F.col("value") >= 100).select(F.col("series").alias("user_id"), "first", "last", "n")


@query("""WITH d AS (SELECT DISTINCT date_diff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS day_idx FROM events), o AS (SELECT day_idx, dense_rank() OVER (ORDER BY day_idx)::INTEGER AS o FROM d)
    SELECT a.o AS fold, b.day_idx, 'train' AS role FROM o a JOIN o b ON b.o < a.o AND b.o >= a.o - 5 AND a.o > 5 UNION ALL SELECT o, day_idx, 'test' FROM o WHERE o > 5""")
def day_cv_folds(spark, d):
    days = table(spark, d, "events").select(F.datediff("ts", F.lit("2020-01-01")).alias("day_idx"))
    return sequences.day_folds(days, "rolling", 5)


DAYS = "WITH d AS (SELECT DISTINCT date_diff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS day_idx FROM events), o AS (SELECT day_idx, dense_rank() OVER (ORDER BY day_idx)::INTEGER AS o FROM d)"


def _days(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.datediff("ts", F.lit("2020-01-01")).alias("day_idx"))


@query(f"{DAYS} SELECT a.o AS fold, b.day_idx, 'train' AS role FROM o a JOIN o b ON b.o < a.o UNION ALL SELECT o, day_idx, 'test' FROM o WHERE o > 1")
def expanding_folds(spark, d):
    return sequences.day_folds(_days(spark, d), "expanding")


@query(f"{DAYS} SELECT a.o AS fold, b.day_idx, 'train' AS role FROM o a JOIN o b ON b.o <> a.o UNION ALL SELECT o, day_idx, 'test' FROM o")
def left_out_days(spark, d):
    return sequences.day_folds(_days(spark, d), "logo")


# ---- tests and intervals -------------------------------------------------------


def _groups(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("group"), F.col("value").alias("v"))


VARIANCES = "g AS (SELECT event_type, var_samp(value) AS v, count(*) AS n FROM events GROUP BY event_type)"


@query(f"WITH {VARIANCES} SELECT round(max(v) / sum(v), 6) AS statistic FROM g")
def cochran(spark, d):
    return spark.createDataFrame([(round(hypothesis.cochran(_groups(spark, d))["statistic"], 6),)], "statistic double")


@query(f"""WITH {VARIANCES}, z AS (SELECT event_type, abs(value - median(value) OVER (PARTITION BY event_type)) AS z FROM events),
    q AS (SELECT event_type, count(*) AS n, avg(z) AS m, sum(z * z) - sum(z) ** 2 / count(*) AS ss FROM z GROUP BY event_type),
    t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM q),
    mo AS (SELECT count(*)::DOUBLE AS n, avg((value - mu) ** 3) / pow(avg((value - mu) ** 2), 1.5) AS s, avg((value - mu) ** 4) / avg((value - mu) ** 2) ** 2 - 3 AS ku FROM (SELECT value, avg(value) OVER () AS mu FROM events)),
    n1 AS (SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b FROM mo),
    n2 AS (SELECT *, sqrt(2 * (b - 1)) - 1 AS w2 FROM n1),
    n3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS al, (ku + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM n2),
    n4 AS (SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / sb ** 2)) AS a FROM n3),
    n5 AS (SELECT delta * ln(y / al + sqrt((y / al) ** 2 + 1)) AS z1, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM n4)
    SELECT 'cochran' AS test, round(max(v) / sum(v), 4) AS statistic FROM g UNION ALL
    SELECT 'bartlett', round((sum(n - 1) * ln(sum((n - 1) * v) / sum(n - 1)) - sum((n - 1) * ln(v))) / (1 + (sum(1.0 / (n - 1)) - 1.0 / sum(n - 1)) / (3 * (count(*) - 1))), 4) FROM g UNION ALL
    SELECT 'levene', round((sum(q.n * (q.m - t.m) ** 2) / (any_value(t.k) - 1)) / (sum(ss) / (any_value(t.n) - any_value(t.k))), 4) FROM q, t UNION ALL
    SELECT 'normality', round(z1 * z1 + z2 * z2, 4) FROM n5""")
def consistency(spark, d):
    r = hypothesis.consistency_report(_groups(spark, d))
    rows = [(k, round(float(v["statistic"]), 4)) for k, v in r.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "test string, statistic double")


@query("SELECT round(max(abs(value - m) / sd), 6) AS statistic, arg_max(event_id, struct_pack(d := abs(value - m), e := -event_id)) AS suspect FROM (SELECT event_id, value, avg(value) OVER () AS m, stddev_samp(value) OVER () AS sd FROM events)")
def grubbs(spark, d):
    r = hypothesis.grubbs(table(spark, d, "events"), v="value", key="event_id")
    return spark.createDataFrame([(round(r["statistic"], 6), r["suspect"])], "statistic double, suspect long")


@query("SELECT count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, round(stddev_samp(value) / abs(avg(value)), 6) AS rsd, round(avg(value), 4) AS middle FROM events")
def precision(spark, d):
    r = hypothesis.precision_summary(table(spark, d, "events"), v="value")
    row = (r["n"], round(r["mean"], 5), round(r["sd"], 5), round(r["rsd"], 6), round(sum(r["ci"]) / 2, 4))
    return spark.createDataFrame([row], "n long, mean double, sd double, rsd double, middle double")


@query("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM events), k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k FROM events), o AS (SELECT (n - least(n, ceil(n * 0.9::DOUBLE))) // 2 AS o, n FROM s)
    SELECT 'mean, sigma 10' AS kind, round(m - 1.959963984540054 * 10 / sqrt(n), 5) AS low, round(m + 1.959963984540054 * 10 / sqrt(n), 5) AS high FROM s UNION ALL
    SELECT 'expectation', round(m - 1.6448536269514722 * sd, 5), round(m + 1.6448536269514722 * sd, 5) FROM s UNION ALL
    SELECT 'nonparametric', round(max(CASE WHEN k = o THEN value END), 5), round(max(CASE WHEN k = n - 1 - o THEN value END), 5) FROM k, o""")
def intervals(spark, d):
    e = table(spark, d, "events")
    found = {"mean, sigma 10": hypothesis.mean_interval(e, sigma=10.0, v="value")}
    found |= {kind: hypothesis.tolerance_interval(e, 0.9, kind=kind, v="value") for kind in ("expectation", "nonparametric")}
    return spark.createDataFrame([(k, round(a, 5), round(b, 5)) for k, (a, b) in found.items()], "kind string, low double, high double")


@query("SELECT event_type, count(*) AS n, min(value) AS low, quantile_disc(value, 0.5) AS middle, max(value) AS high FROM events GROUP BY event_type")
def order_statistics(spark, d):
    ranks = {"low": F.lit(0), "middle": F.ceil(F.col("n") / 2) - 1, "high": F.col("n") - 1}
    return hypothesis.order_statistics(table(spark, d, "events"), ranks, "event_type", "value")


@query("SELECT event_id, CASE WHEN value <= 20 THEN 10 ELSE value END AS floored, CASE WHEN value > 80 THEN 80 ELSE value END AS capped FROM events")
def limit_guards(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", guards.detection_limit(v, 20.0).alias("floored"), guards.range_limit(v, 80.0).alias("capped"))


@query("SELECT event_type, CASE WHEN avg(value) <= 0 OR var_pop(value) / avg(value) > 1.2 THEN 'gamma' WHEN var_pop(value) / avg(value) < 0.8 THEN 'tweedie' ELSE 'poisson' END AS family FROM events GROUP BY event_type")
def glm_family(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return g.select("event_type", guards.glm_family(F.col("m"), F.col("v")).alias("family"))


# ---- models ----------------------------------------------------------------------


@query(f"WITH {LONG} SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.a * b.a), 4) AS v FROM long a JOIN long b USING (vec_id) WHERE a.j <= b.j GROUP BY a.j, b.j")
def gram_products(spark, d):
    m = gram.gram(vectors(spark, d), y=None).m[1:-1, 1:-1]
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "i int, j int, v double").select("i", "j", R("v", 4).alias("v"))


def _calibration(spark, d) -> DataFrame:
    """Spectra with a target made of three channels and a day."""
    df = vectors(spark, d, "label")
    return df.withColumn("y", 2 * F.col("x")[5] - F.col("x")[20] + 0.5 * F.col("x")[40]).withColumnRenamed("label", "day_idx")


TARGET = "SELECT vec_id, 2 * embedding[6]::DOUBLE - embedding[21]::DOUBLE + 0.5 * embedding[41]::DOUBLE AS y FROM embeddings"
EXACT = ("ols", "omp", "lars", "pcr", "pls")


@query(f"SELECT model, vec_id, round(y, 3) + 0.0 AS predicted FROM ({TARGET}), (SELECT unnest({list(EXACT)!r}) AS model)")
def exact_models(spark, d):
    """Models that reproduce a linear target: all samples predicted by each."""
    df = _calibration(spark, d)
    c = gram.gram(df).centred()
    fits = {"ols": linear.ols(c), "omp": linear.omp(c, 3), "lars": linear.lars(c), "pcr": linear.pcr(c, 64), "pls": linear.pls(c, 40)}
    parts = [(R(arrays.dot(F.col("x"), arrays.literal(b)) + (c.mean_y - float(c.mean_x @ b)), 3) + 0.0).alias(k) for k, b in fits.items()]
    wide = df.select(F.col("sample_id").alias("vec_id"), *parts)
    return wide.unpivot("vec_id", list(fits), "model", "predicted").select("model", "vec_id", "predicted")


@query(f"WITH {LONG}, t AS ({TARGET}) SELECT j::INTEGER AS j, round(sum((a - m) * (y - my)), 3) AS v FROM (SELECT vec_id, j, a, avg(a) OVER (PARTITION BY j) AS m FROM long) JOIN (SELECT vec_id, y, avg(y) OVER () AS my FROM t) USING (vec_id) GROUP BY j")
def ridge_equations(spark, d):
    """(X'X + alpha I) b for the fitted b: the normal equations make it X'y."""
    c = gram.gram(_calibration(spark, d)).centred()
    left = (c.xx + 2.5 * np.eye(64)) @ linear.ridge(c, 2.5)
    return spark.createDataFrame([(j, round(float(v), 3)) for j, v in enumerate(left)], "j int, v double")


@query(f"WITH {LONG}, t AS ({TARGET}) SELECT model, j::INTEGER AS j, round(sum((a - m) * (y - my)), 3) AS v FROM (SELECT vec_id, j, a, avg(a) OVER (PARTITION BY j) AS m FROM long) JOIN (SELECT vec_id, y, avg(y) OVER () AS my FROM t) USING (vec_id), (SELECT unnest(['lasso', 'elasticnet']) AS model) GROUP BY model, j")
def sparse_equations(spark, d):
    """X'Xb and the penalty's slope make up X'y; where a coefficient is zero the slope may be any up to the bound."""
    c = gram.gram(_calibration(spark, d)).centred()
    rows = []
    for model, l1 in (("lasso", 1.0), ("elasticnet", 0.5)):
        b = linear.SOLVERS[model](c, 0.005, max_iter=10_000, tol=1e-12)
        bound, left = c.n * 0.005 * l1, c.xx @ b + c.n * 0.005 * (1 - l1) * b
        slope = np.where(b != 0, bound * np.sign(b), np.clip(c.xy - left, -bound, bound))
        rows += [(model, j, round(float(v), 3)) for j, v in enumerate(left + slope)]
    return spark.createDataFrame(rows, "model string, j int, v double")


@query(f"WITH {LONG} SELECT model, j::INTEGER AS j, round(sum(a * label), 3) AS v FROM long, (SELECT unnest(['poisson', 'tweedie']) AS model) GROUP BY model, j")
def score_equations(spark, d):
    """X'mu + n alpha b for fitted generalised models with their natural links: X'y.

    A missing channel adds nothing to the SQL's sums, so it is a zero here; without any label the sums are unknown.
    """
    from .operators import zoo

    found = vectors(spark, d, "label").withColumnRenamed("label", "y").where(F.size("x") > 0)
    # Null only where the value isn't found and an element is null.
    gap = F.array_contains("x", float(np.finfo(float).max)).isNull()
    labels, channels, gaps = found.agg(F.count("y"), F.max(F.size("x")), F.max(gap)).first()
    schema, models, rows = "model string, j int, v double", ("poisson", "tweedie"), []
    if not labels:
        return spark.createDataFrame([(model, j, None) for model in models for j in range(channels or 0)], schema)
    df = found.where("y IS NOT NULL")
    if gaps:
        df = df.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    for model in models:
        m = zoo.build_model(model, alpha=0.01).fit_frame(df)
        g = gram.gram(m.transform(df, "mu"), y="mu")
        rows += [(model, j, round(float(v), 3)) for j, v in enumerate(g.m[1:-1, -1] + g.n * 0.01 * m.coef_)]
    return spark.createDataFrame(rows, schema)


def _trained(spark, d, chain=()):
    from .plans.train import train_model

    df = _calibration(spark, d)
    return df, train_model(df, AXIS, "y", "ols", list(chain), param=WaterParam("Y", (0.5, 1.0), 0.25, 0.75, river_upper=1.5))


BOUNDED = "round(CASE WHEN y < 0.25 THEN 0.125 WHEN y > 1.5 THEN NULL ELSE y END, 5)"


@query(f"SELECT vec_id, {BOUNDED} AS prediction, y < 0.25 AS below_lod, y > 0.75 AND y <= 1.5 AS above_review, y > 1.5 AS not_display FROM ({TARGET})")
def guarded_predictions(spark, d):
    from .plans.serve import predict_with_guard

    df, model = _trained(spark, d)
    out = predict_with_guard(model, df)
    return out.select(F.col("sample_id").alias("vec_id"), R("prediction", 5).alias("prediction"), "below_lod", "above_review", "not_display")


@query(f"SELECT vec_id, {BOUNDED} AS prediction FROM ({TARGET})")
def stored_card(spark, d):
    """Trained on centred spectra, stored, loaded again, served."""
    from .plans.cards import load_cards, save_cards
    from .plans.serve import predict

    df, model = _trained(spark, d, [{"op": "mean_center"}])
    at = scratch(spark)
    save_cards(spark, [model], at)
    (back,) = load_cards(spark, at)
    return predict(back, df, AXIS).select(F.col("sample_id").alias("vec_id"), R("prediction", 5).alias("prediction"))


@query(f"SELECT vec_id, {BOUNDED} AS prediction FROM ({TARGET})")
def compiled_model(spark, d):
    """A chain of linear steps folded into a dot product, stored and loaded."""
    from .plans.serve import EdgeModel

    df, model = _trained(spark, d, [{"op": "column_scale"}])
    at = scratch(spark)
    EdgeModel.compile(model).save(spark, at)
    return EdgeModel.load(spark, at).score(df).select(F.col("sample_id").alias("vec_id"), R("prediction", 5).alias("prediction"))


@query()
def pls_cv(spark, d):
    from .operators.selection import component_errors

    e = component_errors(_calibration(spark, d), "day_idx", 10)
    return spark.createDataFrame([(k + 1, round(float(v), 6)) for k, v in enumerate(e)], "n_components int, rmse double")


@query()
def candidate_pool(spark, d):
    from .plans.train import score_cards, sweep_grid

    df = _calibration(spark, d)
    cards = sweep_grid(df, AXIS, "y", ("pls", "ridge", "ols"), [[], [{"op": "snv"}]], folds=4)
    out = score_cards(cards, df, WaterParam("Y", (0.5, 1, 1.5), abs_error_bound=0.5))
    return out.select("model_type", R("rmse", 4).alias("rmse"), R("rank", 4).alias("rank"))


@query(f"WITH {LONG} SELECT vec_id, round(sum((a - m) ** 2), 4) AS total FROM (SELECT vec_id, j, a, avg(a) OVER (PARTITION BY j) AS m FROM long) GROUP BY vec_id")
def mspc_monitor(spark, d):
    """Squared scores and squared prediction error add up to the squared distance from the mean."""
    out = mspc.fit(vectors(spark, d), 5).monitor(vectors(spark, d))
    return out.select(F.col("sample_id").alias("vec_id"), R(arrays.dot(F.col("scores"), F.col("scores")) + F.col("spe"), 4).alias("total"))


@query(f"""WITH {LONG}, b AS (SELECT vec_id, sum(a * (CASE WHEN j < 32 THEN 1 ELSE -1 END) / 8) AS t, sum(a * a) AS s FROM long GROUP BY vec_id)
    SELECT vec_id, round(t * t, 5) AS t2, round(s - t * t, 5) AS spe, round(greatest(t * t / 0.5, (s - t * t) / 0.9), 5) AS ratio, greatest(t * t / 0.5, (s - t * t) / 0.9) > 1 AS outlier FROM b""")
def flagged_outliers(spark, d):
    basis = np.where(np.arange(64) < 32, 1.0, -1.0)[None, :] / 8
    model = mspc.Mspc(np.zeros(64), basis, np.ones(1), 2, 0.05, 0.5, 0.9)
    out = mspc.flag_outliers(vectors(spark, d), model=model)
    return out.select(F.col("sample_id").alias("vec_id"), R("t2", 5).alias("t2"), R("spe", 5).alias("spe"), R("ratio", 5).alias("ratio"), "outlier")


def _level(m: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One wavelet level as matrices: approximation and detail of m samples, and what gives them back."""
    f, high = len(low), low[::-1] * (-1.0) ** np.arange(1, len(low) + 1)
    n = (m + f - 1) // 2
    forward, back = np.zeros((2, n, m)), np.zeros((2, 2 * n - f + 2, n))
    for k in range(n):
        for i in range(f):
            at = 2 * k + 1 - i
            # Beyond the ends the signal goes on straight.
            inside = {at: 1.0} if 0 <= at < m else {0: 1.0 - at, 1: float(at)} if at < 0 else {m - 1: 1.0 + at - m + 1, m - 2: float(m - 1 - at)}
            for j, v in inside.items():
                forward[:, k, j] += v * low[i], v * high[i]
            t = 2 * k - f + 2 + i
            if 0 <= t < back.shape[1]:
                back[:, t, k] += low[f - 1 - i], high[f - 1 - i]
    return forward[0], forward[1], back[0], back[1]


def _cells_sql(m: np.ndarray, name: str) -> str:
    i, j = np.nonzero(np.abs(m) > 1e-15)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {float(m[r, c])!r}::DOUBLE)" for r, c in zip(i, j)) + ") AS t(i, j, w))"


def _wavelet_sql(low: np.ndarray) -> str:
    """Two levels: coefficients 0 to 20 are approximations, 21 to 41 coarse and 42 to 76 fine details."""
    a1, d1, ra1, rd1 = _level(64, low)
    a2, d2, ra2, rd2 = _level(len(a1), low)
    up = ra1 @ np.eye(len(a1), len(ra2))
    back = np.hstack([up @ ra2, up @ rd2, rd1])[:64]
    coarse, fine = len(a2), 2 * len(a2)
    return f"""WITH {LONG}, {_cells_sql(np.vstack([a2 @ a1, d2 @ a1, d1]), "w")}, {_cells_sql(back, "b")},
    c AS (SELECT vec_id, i, sum(a * w) AS c FROM long JOIN w USING (j) GROUP BY vec_id, i),
    s AS (SELECT vec_id, median(abs(c)) / 0.6745 * sqrt(2 * ln(64)) AS s FROM c WHERE i >= {fine} GROUP BY vec_id),
    t AS (SELECT vec_id, i AS j, CASE WHEN i < {coarse} THEN c ELSE sign(c) * greatest(abs(c) - s, 0) END AS c FROM c JOIN s USING (vec_id))
    SELECT vec_id, i::INTEGER AS j, round(sum(c * w), 5) + 0.0 AS value FROM t JOIN b USING (j) GROUP BY vec_id, i"""


@query(_wavelet_sql(kernels.SYM4))
def wavelet_denoise(spark, d):
    df = vectors(spark, d)
    out = preprocess.fit([{"op": "wavelet"}], df, 64).transform(df)
    long = out.select(F.col("sample_id").alias("vec_id"), F.posexplode("x").alias("j", "a"))
    return long.select("vec_id", "j", (R("a", 5) + 0.0).alias("value"))


ROUGHNESS = 1e3 * np.diff(np.eye(64), n=2, axis=0).T @ np.diff(np.eye(64), n=2, axis=0)


@query(f"WITH {LONG}, {_cells_sql(ROUGHNESS, 'w')} SELECT vec_id, i::INTEGER AS j, round(sum(a * w), 3) + 0.0 AS value FROM long JOIN w USING (j) GROUP BY vec_id, i")
def baseline(spark, d):
    """Residuals r of the last round solve W r + K r = K x, the weights by the side on which the round before left them."""
    df = vectors(spark, d)
    rounds = lambda n, rows: preprocess.fit([{"op": "baseline", "lam": 1e3, "itermax": n}], df, 64).transform(rows)
    before = rounds(9, df.withColumn("raw", F.col("x"))).select("sample_id", F.col("x").alias("before"), F.col("raw").alias("x"))
    out = rounds(10, before)
    weighted = F.zip_with("r", "before", lambda v, b: v * F.when(b > 0, 1e-3).otherwise(1 - 1e-3))
    both = preprocess.multiply(out.withColumn("r", F.col("x")), ROUGHNESS).select("sample_id", F.zip_with("x", weighted, lambda a, b: a + b).alias("x"))
    long = both.select(F.col("sample_id").alias("vec_id"), F.posexplode("x").alias("j", "a"))
    return long.select("vec_id", "j", (R("a", 3) + 0.0).alias("value"))


@query(f"WITH {LONG} SELECT vec_id, j::INTEGER AS j, round(a, 5) + 0.0 AS value FROM long")
def whittaker(spark, d):
    """The penalised system (I + lam D'D) times the smoothed spectrum: the spectrum itself."""
    df = vectors(spark, d)
    out = preprocess.fit([{"op": "whittaker", "lam": 100.0}], df, 64).transform(df)
    system = np.eye(64) + 100.0 * np.diff(np.eye(64), n=2, axis=0).T @ np.diff(np.eye(64), n=2, axis=0)
    back = preprocess.multiply(out, system)
    return back.select(F.col("sample_id").alias("vec_id"), F.posexplode("x").alias("j", "a")).select("vec_id", "j", (R("a", 5) + 0.0).alias("value"))


@query(f"""WITH {LONG}, t AS ({TARGET}), c AS (SELECT vec_id, j, a - avg(a) OVER (PARTITION BY j) AS c, avg(a) OVER (PARTITION BY j) AS m FROM long), u AS (SELECT vec_id, y - avg(y) OVER () AS y FROM t),
    q AS (SELECT j, sum(c * y) AS q FROM c JOIN u USING (vec_id) GROUP BY j), w AS (SELECT j, q / sqrt(sum(q * q) OVER ()) AS w FROM q),
    s AS (SELECT vec_id, sum(c * w) AS t FROM c JOIN w USING (j) GROUP BY vec_id),
    o AS (SELECT vec_id, t, t - y * (sum(t * y) OVER () / sum(y * y) OVER ()) AS o FROM s JOIN u USING (vec_id)),
    p AS (SELECT j, sum(c * o) / (SELECT sum(o * o) FROM o) AS p FROM c JOIN o USING (vec_id) GROUP BY j)
    SELECT vec_id, round(sqrt(sum((c - t * p + m) ** 2)), 4) AS size FROM c JOIN o USING (vec_id) JOIN p USING (j) GROUP BY vec_id""")
def osc(spark, d):
    df = _calibration(spark, d)
    out = preprocess.fit([{"op": "osc"}], df, 64).transform(df)
    return out.select(F.col("sample_id").alias("vec_id"), R(arrays.norm(F.col("x")), 4).alias("size"))


@query(f"WITH {LONG}, c AS (SELECT vec_id, max(CASE WHEN j = 3 THEN greatest(a, 0) END) AS a, max(CASE WHEN j = 40 THEN greatest(a, 0) END) AS b FROM long GROUP BY vec_id) SELECT vec_id, round(a, 6) AS c0, round(b, 6) AS c1, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 6) AS share, round(sqrt(a * a + b * b), 6) AS rebuilt FROM c")
def mixture_projection(spark, d):
    """Non-negative concentrations of two single-channel spectra, closed to shares, and the mixture rebuilt."""
    s = np.eye(64)[[3, 40]]
    df = unmixing.reconstruct(unmixing.project(vectors(spark, d), s), s)
    closed = unmixing.project(df.withColumnRenamed("c", "free"), s, closure=True)
    return closed.select(F.col("sample_id").alias("vec_id"), R(F.col("free")[0], 6).alias("c0"), R(F.col("free")[1], 6).alias("c1"), R(F.col("c")[0], 6).alias("share"), R(arrays.norm(F.col("rebuilt")), 6).alias("rebuilt"))


POSITIVE = "long AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, abs(unnest(embedding)::DOUBLE) AS a FROM embeddings)"


def _positive(spark, d) -> DataFrame:
    return vectors(spark, d).withColumn("x", F.transform("x", lambda v: F.abs(v)))


def _components(spark, s: np.ndarray, digits: int = 5) -> DataFrame:
    return spark.createDataFrame([(k, j, round(float(v), digits) + 0.0) for k, r in enumerate(s) for j, v in enumerate(r)], "component int, j int, value double")


@query(f"""WITH {POSITIVE}, s AS (SELECT j, avg(a) AS m, stddev_pop(a) AS sd, sum(a * a) AS g FROM long GROUP BY j), p AS (SELECT j, g, sd / (m + 0.05::DOUBLE * max(m) OVER ()) AS p FROM s),
    c1 AS (SELECT j AS c, g FROM p ORDER BY p DESC, j LIMIT 1), x1 AS (SELECT vec_id, a AS u FROM long, c1 WHERE j = c), g1 AS (SELECT j, sum(a * u) AS g1 FROM long JOIN x1 USING (vec_id) GROUP BY j),
    c2 AS (SELECT p.j AS c, p.g, g1 AS g12 FROM p JOIN g1 USING (j), c1 WHERE p.j <> c1.c ORDER BY p.p * sqrt(1 - g1 * g1 / (p.g * c1.g)) DESC, p.j LIMIT 1),
    x2 AS (SELECT vec_id, a AS u FROM long, c2 WHERE j = c), g2 AS (SELECT j, sum(a * u) AS g2 FROM long JOIN x2 USING (vec_id) GROUP BY j),
    r AS (SELECT j, 0 AS component, greatest(0, c2.g * g1 - g12 * g2) AS v FROM g1 JOIN g2 USING (j), c2 UNION ALL SELECT j, 1, greatest(0, c1.g * g2 - g12 * g1) FROM g1 JOIN g2 USING (j), c1, c2)
    SELECT component::INTEGER AS component, j::INTEGER AS j, round(v / sqrt(sum(v * v) OVER (PARTITION BY component)), 5) + 0.0 AS value FROM r""")
def purest_channels(spark, d):
    return _components(spark, unmixing.simplisma(_positive(spark, d), 2))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: greatest(v, 0)) AS x FROM embeddings), n AS (SELECT vec_id, x, list_dot_product(x, x) AS q FROM x),
    a AS (SELECT * FROM n ORDER BY q DESC, vec_id LIMIT 1), b AS (SELECT n.* FROM n, a WHERE n.vec_id <> a.vec_id ORDER BY n.q - list_dot_product(n.x, a.x) ** 2 / a.q DESC, n.vec_id LIMIT 1)
    SELECT 0 AS component, (generate_subscripts(x, 1) - 1)::INTEGER AS j, round(unnest(x), 5) AS value FROM a UNION ALL SELECT 1, (generate_subscripts(x, 1) - 1)::INTEGER, round(unnest(x), 5) FROM b""")
def orthogonal_spectra(spark, d):
    return _components(spark, unmixing.orthogonal_projection(vectors(spark, d), 2))


@query(f"""WITH {POSITIVE}, t AS (SELECT vec_id AS i, j, a FROM long WHERE j < 2), p AS (SELECT j, arg_max(i, struct_pack(a := a, i := -i)) AS peak FROM t GROUP BY j)
    SELECT i AS vec_id, j::INTEGER AS component, round(CASE WHEN i <= peak THEN max(a) OVER (PARTITION BY j ORDER BY i ROWS UNBOUNDED PRECEDING) ELSE max(CASE WHEN i > peak THEN a END) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END, 6) AS value FROM t JOIN p USING (j)""")
def single_peaks(spark, d):
    """Concentrations that rise and fall once along the samples."""
    found = unmixing.single_peaks(_positive(spark, d).withColumn("c", F.slice("x", 1, 2)))
    return found.select(F.col("sample_id").alias("vec_id"), F.posexplode("c").alias("component", "v")).select("vec_id", "component", R("v", 6).alias("value"))


@query(f"""WITH {LONG}, z AS (SELECT vec_id, sum(a * ((j % 7) - 3) / 10) AS p FROM long GROUP BY vec_id), w AS (SELECT sqrt(sum((((j % 7) - 3) / 10.0) ** 2)) AS w, sqrt(sum(CASE WHEN j < 32 THEN (((j % 7) - 3) / 10.0) ** 2 ELSE 0 END)) AS u FROM (SELECT unnest(range(64)) AS j)),
    n AS (SELECT sqrt(sum(c * c) / count(*)) AS s FROM (SELECT a - avg(a) OVER (PARTITION BY vec_id) AS c FROM long))
    SELECT round(1 / any_value(w), 6) AS sen, round(1 / any_value(w) / any_value(s), 6) AS gamma, round(any_value(s), 6) AS s_x, round(stddev_samp(p), 6) AS s_0, round(3.3 * stddev_samp(p) * any_value(w), 5) AS lod, round(10 * stddev_samp(p) * any_value(w), 5) AS loq, round(any_value(u) / any_value(w), 6) AS sel FROM z, w, n""")
def figures_of_merit(spark, d):
    coef = (np.arange(64) % 7 - 3) / 10
    r = fom.figures_of_merit(coef, 0.5, vectors(spark, d), (np.arange(64) < 32).astype(float))
    digits = {"lod": 5, "loq": 5}
    return spark.createDataFrame([tuple(round(float(v), digits.get(k, 6)) for k, v in r.items())], ", ".join(f"{k} double" for k in r))


@query("SELECT k AS component, l AS level, CASE WHEN k = 0 THEN l / 4.0 ELSE 0.0 END AS c0, CASE WHEN k = 1 THEN 2 + l / 2.0 ELSE 2.0 END AS c1 FROM (SELECT unnest(range(2))::INTEGER AS k), (SELECT unnest(range(5))::INTEGER AS l) UNION ALL SELECT -1, 0, 0.5, 3.0")
def diagonal_design(spark, d):
    from .operators.selection import diagonal_design

    return diagonal_design(spark, 5, ((0, 1), (2, 4)))


@query(f"""WITH {LONG}, x AS (SELECT vec_id, max(CASE WHEN j = 0 THEN a END) AS a, max(CASE WHEN j = 1 THEN a END) AS b, max(a) AS top FROM long GROUP BY vec_id), g AS (SELECT avg(CASE WHEN 60 * a + 20 <= 0.5 THEN 0.25 WHEN 60 * a + 20 > 150 THEN 150 ELSE 60 * a + 20 END) AS tur, max(top) AS top FROM x)
    SELECT vec_id, round(CASE WHEN k <= 0.5 THEN 0.25 WHEN k > 20 THEN 20 ELSE k END, 5) AS kmno FROM (SELECT vec_id, CASE WHEN tur <= 20 AND g.top <= 1 THEN b * 3 + 4 ELSE b * 5 + 9 END AS k FROM x, g)""")
def river_branch(spark, d):
    from .plans import river

    on = lambda j, v: [v if i == j else 0.0 for i in range(64)]
    clear = {"KMNO": [(on(1, 3.0), 4.0)]}
    wide = {"TUR": [(on(0, 60.0), 20.0)], "KMNO": [(on(1, 5.0), 9.0)]}
    out = river.predict_branch(vectors(spark, d), clear, wide)
    return out.select(F.col("sample_id").alias("vec_id"), R("KMNO", 5).alias("kmno"))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import uuid

    from .functions.storage import shared_folder

    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


@query(f"WITH {LONG} SELECT vec_id, j::INTEGER AS j, round(a, 6) + 0.0 AS value FROM long")
def arff_file(spark, d):
    """Written as an ARFF file, columns by name, and read back."""
    from .sources.arff import read_arff

    at = scratch(spark)
    head = ["@relation spectra", "@attribute vec_id numeric", *[f"@attribute 'wl_{nm}' numeric" for nm in AXIS], "@data"]
    rows = vectors(spark, d).select(F.concat_ws(",", F.col("sample_id").cast("string"), F.transform("x", lambda v: v.cast("string"))).alias("value"))
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{at}/head")
    rows.write.text(f"{at}/body")
    back, axis = read_arff(spark, [f"{at}/head", f"{at}/body"])
    if axis != AXIS:
        raise ValueError("the axis read differs from the one written")
    long = back.select(F.col("vec_id").cast("long").alias("vec_id"), F.posexplode("x").alias("j", "a"))
    return long.select("vec_id", "j", (R("a", 6) + 0.0).alias("value"))


@query("SELECT label::INTEGER AS day_idx, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, round(embedding[64]::DOUBLE, 6) + 0.0 AS last, vec_id::DOUBLE AS y FROM embeddings")
def wide_csv(spark, d):
    """Written as a wide CSV file and read back by column names."""
    from .sources.tables import read_wide_csv

    at = scratch(spark)
    df = vectors(spark, d, "label")
    df.select(F.col("label").alias("DAY_idx"), F.col("sample_id").alias("id"), *[F.col("x")[j].alias(f"wavelength_{j + 1}") for j in range(64)]).write.csv(at, header=True)
    back, _ = read_wide_csv(spark, at, labels=("y=id",))
    return back.select("day_idx", (R(F.col("x")[0], 6) + 0.0).alias("first"), (R(F.col("x")[63], 6) + 0.0).alias("last"), "y")


@query("SELECT vec_id, label, 2 * embedding[3]::DOUBLE AS second FROM embeddings WHERE label IN (1, 2)")
def chosen_spectra(spark, d):
    """Kept by a table of ids, without another one, values replaced, channels gathered."""
    df = vectors(spark, d, "label")
    ids = lambda *k: df.where(F.col("label").isin(*k)).select("sample_id")
    out = spectra.without_ids(spectra.select_ids(df, ids(1, 2, 3)), ids(3))
    out = spectra.with_values(out, F.transform("x", lambda v: 2 * v))
    return out.select(F.col("sample_id").alias("vec_id"), "label", arrays.gather(F.col("x"), [0, 2, 5])[1].alias("second"))


@query("SELECT vec_id, label::DOUBLE AS y FROM embeddings WHERE label <> 9 AND label <> 4")
def labelled_spectra(spark, d):
    """Joined with labels of which some are NaN and some missing."""
    df = vectors(spark, d, "label")
    y = F.when(F.col("label") == 9, F.lit(float("nan"))).otherwise(F.col("label").cast("double"))
    labels = df.where("label <> 4").select("sample_id", F.lit("TN").alias("param"), y.alias("y"))
    out = spectra.labelled(df, labels.unionByName(labels.withColumn("param", F.lit("TP"))), "TN")
    return out.select(F.col("sample_id").alias("vec_id"), "y")


@query("SELECT count(*)::INTEGER AS n_samples, any_value(len(embedding))::INTEGER AS n_wavelengths, 8.0::DOUBLE AS step, count(DISTINCT label)::INTEGER AS instruments FROM embeddings")
def shape(spark, d):
    df = vectors(spark, d, F.col("label").alias("instrument_id"))
    s = spectra.shape(spectra.validate(df, AXIS), AXIS)
    return spark.createDataFrame([(s["n_samples"], s["n_wavelengths"], s["step"], spectra.instrument_ids(df).count())], "n_samples int, n_wavelengths int, step double, instruments int")


@query("WITH c AS (SELECT vec_id, abs(embedding[4]::DOUBLE) AS a, abs(embedding[41]::DOUBLE) AS b FROM embeddings) SELECT vec_id, j::INTEGER AS j, round(a * greatest(0, 1 - abs(j - 18) / 16.0) + b * greatest(0, 1 - abs(j - 44) / 16.0), 6) + 0.0 AS value FROM c, (SELECT unnest(range(64)) AS j)")
def resolved_mixture(spark, d):
    """Two overlapping bands mixed, resolved from their mixtures alone, and mixed again."""
    bands = np.maximum(0, 1 - np.abs(np.arange(64)[None, :] - np.array([[18], [44]])) / 16)
    c = F.array(F.abs(F.col("x")[3]), F.abs(F.col("x")[40]))
    mixed = unmixing.reconstruct(vectors(spark, d).select("sample_id", c.alias("c")), bands).select("sample_id", F.col("rebuilt").alias("x"))
    s = unmixing.mcr_als(mixed, 2).spectra
    again = unmixing.reconstruct(unmixing.project(mixed, s), s)
    return again.select(F.col("sample_id").alias("vec_id"), F.posexplode("rebuilt").alias("j", "v")).select("vec_id", "j", (R("v", 6) + 0.0).alias("value"))


@query(f"WITH {LONG}, c AS (SELECT vec_id, a - avg(a) OVER (PARTITION BY vec_id) AS c FROM long) SELECT round(sqrt(sum(c * c) / count(*)), 6) AS s_x FROM c")
def spectral_noise(spark, d):
    return spark.createDataFrame([(round(fom.spectral_noise(vectors(spark, d)), 6),)], "s_x double")


# ---- figure data, files ----------------------------------------------------------


@query(f"WITH {PAIRS} SELECT std_id, 200.0::DOUBLE + 8 * j AS nm, round(m - s, 6) + 0.0 AS difference FROM p")
def difference_points(spark, d):
    from .operators import figures

    out = figures.difference_points(*standards(spark, d), AXIS, "std_id")
    return out.select(F.col("std_id").cast("long").alias("std_id"), "nm", (R("a", 6) + 0.0).alias("difference"))


@query(f"WITH {LONG}, {polynomial_matrix(64, 15, 3, 1)} SELECT vec_id, 200.0::DOUBLE + 8 * i AS nm, round(sum(a * w), 6) + 0.0 AS slope FROM long JOIN w USING (j) GROUP BY vec_id, i")
def derivative_points(spark, d):
    from .operators import figures

    out = figures.derivative_points(vectors(spark, d), AXIS)
    return out.select(F.col("sample_id").alias("vec_id"), "nm", (R("a", 6) + 0.0).alias("slope"))


@query(f"WITH {PRED} SELECT seq, round(y_pred - y_true, 5) AS residual FROM pred")
def fitted_points(spark, d):
    from .operators import figures

    return figures.fitted_points(predictions(spark, d)).select("seq", R("residual", 5).alias("residual"))


@query(f"WITH {SCORED}, {_rank_sql()} SELECT model_type, round(r.rank, 5) AS rank, round(m.rmse, 5) AS rmse FROM r JOIN m USING (model_type)")
def scoring_file(spark, d):
    """Scores written as a CSV file, merged into it once more, and read back."""
    from .sources.tables import read_scores, write_scores

    at = f"{scratch(spark)}/scores"
    scores = event_scores(spark, d)
    write_scores(scores, at)
    write_scores(scores.where("model_type <> 'view'"), at, merge=True)
    return read_scores(spark, at).select("model_type", R("rank", 5).alias("rank"), R("rmse", 5).alias("rmse"))


@query("SELECT user_id AS file_id, count(*) AS items, arg_min(value, event_id) AS first_tn, round(sum(value / 2), 4) AS an FROM events GROUP BY user_id")
def result_files(spark, d):
    """One JSON result per user, read back."""
    from .sources.tables import result_json

    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("sample_id"), F.col("value").alias("TN"), (F.col("value") / 2).alias("AN"))
    item = F.from_json("json", "id long, item array<struct<TN: double, AN: double>>")["item"]
    out = result_json(e).select("file_id", item.alias("item"))
    return out.select("file_id", F.size("item").cast("long").alias("items"), F.col("item")[0]["TN"].alias("first_tn"), R(F.aggregate("item", F.lit(0.0), lambda a, i: a + i["AN"]), 4).alias("an"))


@query(f"WITH {LONG} SELECT count(DISTINCT vec_id) FILTER (label = 3) AS label, count(*) FILTER (a > 0.2) AS x FROM long")
def missing_values(spark, d):
    from .sources.tables import missing_counts

    gone = lambda c, test: F.when(~test, c)
    df = vectors(spark, d, "label").select(gone(F.col("label"), F.col("label") == 3).alias("label"), F.transform("x", lambda v: gone(v, v > 0.2)).alias("x"))
    return missing_counts(df).select("label", "x")


# ---- streams ---------------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    at = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{at}*")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for the files that exist now, by way of the shared folder."""
    spark = stream.sparkSession
    at = scratch(spark)
    # Each batch has its folder, so one that runs again replaces its rows; in complete mode the last holds all.
    folder = lambda k: f"{at}/rows/batch={k if mode == 'append' else 0}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    run.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(folder(k))).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows").drop("batch")


def _forecast() -> list:
    return [F.col("value").alias("y_true"), (F.col("value") * (0.9 + 0.02 * (F.col("event_id") % 11))).alias("y_pred")]


FORECAST = "f AS (SELECT event_id, ts, value AS t, value * (0.9::DOUBLE + 0.02::DOUBLE * (event_id % 11)) AS p FROM events)"


@query(f"WITH {FORECAST} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(CASE WHEN var_pop(t) > 0 THEN 1 - sum((t - p) ** 2) / (var_pop(t) * count(*)) END, 5) AS r2 FROM f GROUP BY ALL")
def stream_daily_acceptance(spark, d):
    from .streaming import control

    out = drained(control.daily_acceptance(event_stream(spark, d).select("ts", *_forecast())), "complete")
    return out.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n", R("r2", 5).alias("r2"))


@query(f"""WITH {FORECAST}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, t >= 100 AS t, p >= 100 AS p FROM f, range(4) r(k))
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM w GROUP BY ALL""")
def stream_alarm_counts(spark, d):
    from .streaming import control

    out = drained(control.alarm_counts(event_stream(spark, d).select("ts", *_forecast()), 100.0), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "tp", "fp", "fn", "tn")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, value, (value - 100) / 60.0::DOUBLE AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events),
    s AS (SELECT *, sum(CASE WHEN i > 1 THEN u - 0.5 ELSE 0 END) OVER w AS s, sum(CASE WHEN i > 1 THEN u + 0.5 ELSE 0 END) OVER w AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, s - min(s) OVER w AS c_pos, t - max(t) OVER w AS c_neg FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT user_id, i, 0.2::DOUBLE * value + 80 AS z FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.2::DOUBLE * e.value + 0.8::DOUBLE * r.z FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, value, round(c_pos, 5) + 0.0 AS c_pos, round(c_neg, 5) + 0.0 AS c_neg, round(z, 5) AS ewma, c_pos > 5 OR c_neg < -5 AS cusum_alarm, abs(z - 100) > 180 * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * i))) AS ewma_alarm FROM c JOIN r USING (user_id, i)""")
def stream_control_chart(spark, d):
    from .streaming import control

    e = event_stream(spark, d).select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("seq"), "value")
    out = drained(control.control_chart(e, 100.0, 60.0), "append")
    return out.select(F.col("series").cast("long").alias("user_id"), "value", *[(R(c, 5) + 0.0).alias(c) for c in ("c_pos", "c_neg", "ewma")], "cusum_alarm", "ewma_alarm")
