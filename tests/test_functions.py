import math

import numpy as np
import pytest

from specloom.functions import kernels, special


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (special.f_ppf(0.95, 5, 115), 2.29320),
        (special.t_ppf(0.975, 10), 2.22814),
        (special.t_ppf(0.025, 10), -2.22814),
        (special.chi2_ppf(0.95, 3), 7.81473),
        (special.norm_ppf(0.975), 1.95996),
        (special.f_sf(2.29320, 5, 115), 0.05),
        (special.chi2_sf(7.81473, 3), 0.05),
    ],
)
def test_distributions(got, want):
    assert got == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("window", [11, 17])
@pytest.mark.parametrize("deriv", [0, 1, 2])
def test_smoothing_is_exact_on_polynomials(window, deriv):
    x = np.arange(60, dtype=float)
    y = 0.3 * x**2 - 2 * x + 5
    want = {0: y, 1: 0.6 * x - 2, 2: np.full(60, 0.6)}[deriv]
    assert np.allclose(kernels.smoothing_matrix(60, window, 2, deriv) @ y, want, atol=1e-8)


@pytest.mark.parametrize(("window", "order", "p"), [(10, 2, 60), (61, 2, 60), (5, 5, 60), (0, 0, 60)])
def test_bad_windows(window, order, p):
    with pytest.raises(ValueError):
        kernels.smoothing_matrix(p, window, order)


@pytest.mark.parametrize("n", [63, 64, 101, 200])
def test_wavelet_round_trip(n):
    x = np.random.default_rng(0).normal(size=(4, n)).cumsum(1)
    a, d = kernels.dwt(x)
    assert a.shape[1] == (n + 7) // 2 and np.allclose(kernels.idwt(a, d)[:, :n], x, atol=1e-9)
    f = kernels.SYM4
    assert f.sum() == pytest.approx(math.sqrt(2)) and f @ f == pytest.approx(1) and f[2:] @ f[:-2] == pytest.approx(0, abs=1e-10)


@pytest.mark.parametrize("name", ["haar", "sym3", *[f"db{k}" for k in range(1, 13)]])
def test_wavelets_by_name(name):
    low = np.array(kernels.wavelet_filter(name))
    assert low.sum() == pytest.approx(math.sqrt(2)) and low @ low == pytest.approx(1)
    # As many moments of the high-pass filter vanish as the name says.
    high = low * (-1.0) ** np.arange(len(low))
    assert all(abs(high @ (np.arange(len(low)) / len(low)) ** k) < 1e-8 for k in range(len(low) // 2))
    x = np.random.default_rng(0).normal(size=(3, 101)).cumsum(1)
    assert np.allclose(kernels.idwt(*kernels.dwt(x, tuple(low)), tuple(low))[:, :101], x, atol=1e-8)


def test_wavelet_names():
    assert np.allclose(kernels.wavelet_filter("db2"), np.array([1 - 3**0.5, 3 - 3**0.5, 3 + 3**0.5, 1 + 3**0.5]) / (4 * 2**0.5))
    for name in ("db0", "db13", "sym1", "sym5", "haar2", "x"):
        with pytest.raises(ValueError):
            kernels.wavelet_filter(name)


def test_wavelet_removes_noise():
    rng, i = np.random.default_rng(0), np.arange(200)
    clean = np.exp(-(((i - 90) / 25) ** 2))
    noisy = clean + rng.normal(0, 0.05, (5, 200))
    assert ((kernels.wavelet_denoise(noisy) - clean) ** 2).mean() < 0.5 * ((noisy - clean) ** 2).mean()


def test_whittaker_matches_the_dense_solution():
    x = np.random.default_rng(0).normal(size=(3, 80))
    d = kernels.difference(80, 2)
    assert np.allclose(kernels.whittaker(x, 50.0), np.linalg.solve(np.eye(80) + 50 * d.T @ d, x.T).T)
    for bad in ((0, 2), (1.0, 0)):
        with pytest.raises(ValueError):
            kernels.whittaker(x, *bad)


def test_baseline_follows_a_line_under_a_peak():
    i = np.arange(201)
    y = (0.2 + 0.005 * i + 2 * np.exp(-(((i - 100) / 8.0) ** 2) / 2))[None, :]
    rest = y - kernels.asymmetric_baseline(y)
    assert rest.max() > 1.5 and np.abs(rest[0, :60]).max() < 0.05


def test_nnls_against_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=(12, 3)), rng.normal(size=12)
        best = min((np.linalg.norm(a @ z - b), tuple(z)) for on in ([], [0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]) for z in [_fit(a, b, on)] if (z >= -1e-12).all())
        assert np.linalg.norm(a @ kernels.nnls(a, b) - b) == pytest.approx(best[0], abs=1e-9)


def _fit(a, b, on):
    z = np.zeros(3)
    if on:
        z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
    return z
