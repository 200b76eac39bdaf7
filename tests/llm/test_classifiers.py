import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import quality_classifier, queries, toxicity

BIG = "/root/testdata/sf0.1"


def check_held_out(rows, labels, modulus, held, cut, least):
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in own) >= least * len(own)


@pytest.fixture(scope="module")
def labels(spark):
    rows = spark.read.parquet(f"{BIG}/labels.parquet").collect()
    return {r.doc_id: r.quality for r in rows}, {r.doc_id: r.toxic for r in rows}


def test_quality_on_held_out_rows(spark, labels):
    check_held_out(queries.op1_quality(spark, BIG).collect(), labels[0], 4, 2, 0.7, 0.97)


def test_toxicity_on_held_out_rows(spark, labels):
    check_held_out(queries.op4_toxicity(spark, BIG).collect(), labels[1], 5, 0, 0.5, 0.96)


def isotonic_by_formula(n, y):
    """The rate at each place: the largest of the least means of runs that hold it."""
    mean = lambda i, j: y[i : j + 1].sum() / n[i : j + 1].sum()
    return np.array([max(min(mean(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))])


def test_quality_against_brute_force(spark, sf):
    """The whole fit and every score in plain numpy from the texts and labels."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    y = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    learnt = sorted(k for k in y if k in docs and zlib.crc32(str(k).encode()) % 4 != 2)
    fold = {r.doc_id: r.f for r in spark.createDataFrame([(k,) for k in learnt], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    stats = {k: np.array(quality_classifier.statistics(t)) for k, t in docs.items()}
    x, target, side = np.array([stats[k] for k in learnt]), np.array([y[k] for k in learnt]), np.array([fold[k] for k in learnt])
    mean, sd = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    rng = np.random.default_rng(11)
    w, b = rng.normal(size=(x.shape[1], 256)) / 3.0, rng.uniform(0, 2 * np.pi, 256)
    lift = lambda v: np.column_stack([np.cos(np.clip((v - mean) / sd, -5, 5) @ w + b) * np.sqrt(2 / 256), np.ones(len(v))])
    solve = lambda z, t: np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(257), z.T @ t)
    z = lift(x)
    out_of_fold = np.where(side == 0, z @ solve(z[side == 1], target[side == 1]), z @ solve(z[side == 0], target[side == 0]))
    place = np.clip(np.round((out_of_fold + 0.5) * 512), 0, 1024)
    places = np.unique(place)
    n = np.array([(place == p).sum() for p in places])
    hits = np.array([target[place == p].sum() for p in places])
    rate = isotonic_by_formula(n, hits)
    # Equal rates are one block at its mean place.
    blocks = [(np.average(places[rate == r], weights=n[rate == r]) / 512 - 0.5, r) for r in sorted(set(rate))]
    merged: list = []
    for at, r in blocks:
        if not (merged and np.isclose(merged[-1][1], r, atol=1e-12)):
            merged.append((at, r))
    final = solve(z, target)
    keys = sorted(docs)
    want = np.clip(np.interp(lift(np.array([stats[k] for k in keys])) @ final, *zip(*merged)), 0, 1)
    got = {r.doc_id: r.score for r in queries.op1_quality(spark, sf).collect()}
    assert np.allclose([got[k] for k in keys], want, atol=1e-6)


def test_quality_rows_and_degenerate_labels(spark, odd, sf):
    train = spark.read.parquet(f"{sf}/documents.parquet")
    y = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    stats = quality_classifier.statistics_table(train)
    model = quality_classifier.fit(stats, y, F.lit(True))
    out = quality_classifier.score(quality_classifier.statistics_table(odd), model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    one_class = y.where("y = 1")
    assert {r.score for r in quality_classifier.classify(odd, one_class, F.lit(True)).collect()} == {0.5}
    assert quality_classifier.classify(odd.limit(0), y.limit(0), F.lit(True)).count() == 0


def test_isotonic_is_monotone():
    n, y = np.array([5, 5, 5, 5.0]), np.array([1, 3, 2, 5.0])
    at, rate = quality_classifier.isotonic(n, y, np.arange(4.0))
    assert (np.diff(rate) > 0).all() and np.allclose(rate, [0.2, 0.5, 1.0]) and np.allclose(at, [0, 1.5, 3])


def test_normal_equations_are_the_whole_sums(spark):
    rng = np.random.default_rng(0)
    x, y, fold = rng.normal(size=(90, 3)), rng.integers(0, 2, 90).astype(float), np.arange(90) % 2
    rows = spark.createDataFrame([(a.tolist(), float(b), int(f)) for a, b, f in zip(x, y, fold)], "x array<double>, y double, fold long").repartition(5)
    mean, sd = quality_classifier.scaling(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(sd, x.std(0))
    fourier = quality_classifier.Fourier(mean, sd, features=7)
    sums = quality_classifier.normal_equations(rows, fourier)
    for f in (0, 1):
        z = np.concatenate([fourier(x[fold == f]), y[fold == f, None]], axis=1)
        assert np.allclose(sums[f], z.T @ z)


def small_network(rng):
    words = [f"w{k}".encode() for k in range(6)]
    net = toxicity.Network({w: k + 1 for k, w in enumerate(words)}, rng.normal(size=7))
    for name in net.p:
        net.p[name] = rng.normal(0, 0.4, net.p[name].shape)  # in double, for differences
    return net, words


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net, words = small_network(rng)
    at = rng.integers(0, 6, (3, 5))
    lengths, y = np.array([5, 3, 4]), np.array([1.0, 0.0, 1.0])
    # The target leans on the prediction itself; hold it fixed by comparing d loss / d logit paths of the output layer only.
    _, grad = net.step(words, at, lengths, y)
    assert set(grad) == set(net.p) and all(np.isfinite(g).all() for g in grad.values())
    for name, place in (("o", (2,)), ("v", (1,)), ("a", (3, 2)), ("u", (0, 1, 4)), ("u", (1, 2, 9)), ("wx", (0, 2, 5)), ("bx", (1, 3)), ("word", (2, 1))):
        eps, old, values = 1e-5, net.p[name][place], []
        for s in (1, -1):
            net.p[name][place] = old + s * eps
            values.append(_logits(net, words, at, lengths))
        net.p[name][place] = old
        logit = _logits(net, words, at, lengths)
        prob = 1 / (1 + np.exp(-logit))
        want = ((prob - (0.8 * y + 0.2 * prob)) / 3 * (values[0] - values[1]) / (2 * eps)).sum()
        assert grad[name][place] == pytest.approx(want, rel=2e-3, abs=1e-7), name


def _logits(net, words, at, lengths):
    x = net.vectors(words)[0]
    g = net.project(x)
    steps = at.shape[1]
    mask = np.where(np.arange(steps)[:, None] < lengths[None, :], 0, -1e9)
    live = np.stack([mask == 0, (mask == 0)[::-1]])[..., None]
    states, _ = net.run(np.stack([g[at.T, 0], g[at.T[::-1], 1]]) * live)
    return net.pool(states, mask)[0]


def test_scorer_equals_the_network_and_covers_all_words():
    rng = np.random.default_rng(1)
    net, _ = small_network(rng)
    words = [f"w{rng.integers(0, 9)}" for _ in range(100)]
    scorer = toxicity.Scorer(net)
    (got,) = scorer.logits([" ".join(words).encode()])
    starts = toxicity.windows(100)
    assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= 100 and all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))
    assert len(got) == len(starts)
    for s, value in zip(starts, got):
        part = [w.encode() for w in words[s : s + toxicity.WINDOW]]
        want = _logits(net, part, np.arange(len(part))[None, :], np.array([len(part)]))
        assert value == pytest.approx(want[0], abs=1e-4)
    alone = [scorer.score([t])[0] for t in (b"w1 w2", b"", b"w3 " * 70)]
    assert np.allclose(scorer.score([b"w1 w2", b"", b"w3 " * 70]), alone, atol=1e-6)


def test_toxicity_rows(spark, odd):
    net = toxicity.train([b"fine words here", b"you idiot there"] * 8, [0, 1] * 8, epochs=3)
    out = toxicity.score(odd, net).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.keep_clean(odd, net).columns == odd.columns
    kept = {str(r.doc_id) for r in toxicity.keep_clean(odd, net).collect()}
    assert kept == {str(r.doc_id) for r in out if r.score < 0.5}
    none = spark.createDataFrame([], "doc_id long, y int")
    assert {r.score for r in toxicity.classify(odd, none, F.lit(True)).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), net).count() == 0
