"""Kernels against direct sums, analytic signals and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochlake.operators import spectral as S
from epochlake.plans.pipeline import window_slice


def test_morlet_is_the_direct_convolution():
    x = np.random.default_rng(0).standard_normal(100)
    w = S.morlet(5.0, 64.0, 3.5)
    half = len(w) // 2
    direct = [sum(x[j] * w[k - j + half] for j in range(100) if 0 <= k - j + half < len(w)) for k in range(100)]
    assert np.allclose(S.morlet_power(x, np.array([5.0]), 64.0, np.array([3.5]))[0], np.abs(direct) ** 2)
    assert np.isclose(np.linalg.norm(w), np.sqrt(2))


def test_morlet_peaks_at_a_sinusoid_and_ignores_a_constant():
    t = np.arange(2000) / 200
    f = np.arange(3.0, 12.0)
    p = S.morlet_power(np.sin(2 * np.pi * 6 * t), f, 200.0, S.cycles(f, "fixed"))
    assert f[p[:, 1000].argmax()] == 6
    assert S.morlet_power(np.full(2000, 7.0), f, 200.0, S.cycles(f, "fixed"))[:, 1000].max() < 1e-6


def test_welch_integrates_to_the_variance():
    x = np.random.default_rng(1).standard_normal(1 << 15)
    f, p = S.welch(x, 200.0, 1024)
    assert abs((p * (f[1] - f[0])).sum() - x.var()) < 0.05
    f, p = S.multitaper(x[:512], 200.0)
    assert abs((p * (f[1] - f[0])).sum() - x[:512].var()) < 0.2


def test_slepian_tapers_are_orthonormal():
    tapers, lam = S.slepian(64)
    assert np.allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-8)
    assert lam[0] > 0.999


def test_cwt_centre():
    f = np.arange(4.0, 20.0)
    t = np.arange(4000) / 200
    p = S.cwt_power(np.sin(2 * np.pi * 8 * t), f, 200.0)
    assert abs(f[p[:, 2000].argmax()] - 8 * 2 * np.pi / 5) <= 1


@pytest.mark.parametrize("method,want", [("fixed", 5.0), ("adaptive", 4.0), ("hybrid", 6.0), ("custom", 3.25)])
def test_cycles(method, want):
    assert S.cycles(np.array([4.0]), method)[0] == want


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 30), st.integers(1, 300))
def test_window_slice_has_n_samples_or_none(e, n):
    times = 5 + np.arange(4000) / 200
    cut = window_slice(times, e, 1.0, n)
    inside = e - 1 >= times[0] and e + 1 <= times[-1]
    assert (cut is not None) == inside
    if inside:
        assert len(cut) == n and (np.diff(cut) >= 0).all()


def test_golden_window_and_axis():
    from epochlake.functions.columns import axis_range

    assert len(axis_range(400, 1.0, -1.0, -0.5)) == 100 and len(axis_range(400, 1.0, -0.2, 0.0)) == 40
    assert len(axis_range(200, 0.5, -1.0, -0.5)) == 1
    times = 5 + np.arange(4000) / 200
    assert all(len(window_slice(times, e, 1.0, 400)) == 400 for e in np.linspace(6, 23, 50))


def test_trials_with_a_burst(spark):
    """Ten trials, a burst in half of them: z against all samples and against the pre-event baseline."""
    from epochlake.operators import normalize

    rng = np.random.RandomState(42)
    p = rng.normal(1, 0.1, (10, 15, 200))
    t = np.linspace(-1, 1, 200)
    p[5:, 7] += 3 * np.exp(-((t - 0.1) ** 2) / (2 * 0.02**2))
    ks = np.flatnonzero((t >= -0.6) & (t <= -0.2)).tolist()
    trials = spark.createDataFrame([(i, p[i, 7].tolist()) for i in range(10)], "trial int, w array<double>")
    mean = lambda df: np.mean([r["w"][109] for r in df.collect()])
    assert len(ks) == 40
    assert np.allclose([p[:, 7, 109].mean(), mean(normalize.trial(trials)), mean(normalize.trial(trials, ks))], [2.471401, 3.668029, 15.385852], atol=1e-5)


@pytest.mark.parametrize("n,half", [(64, 4.0), (65, 4.0), (1000, 4.0), (301, 2.5), (9, 4.0), (2, 1.0), (1, 0.5)])
def test_tapers_are_the_dense_eigenvectors(n, half):
    k, w = np.arange(n), half / n
    both = np.diag(k[1:] * (n - k[1:]) / 2.0, 1)
    vectors = np.linalg.eigh(np.diag(((n - 1 - 2 * k) / 2.0) ** 2 * np.cos(2 * np.pi * w)) + both + both.T)[1][:, ::-1]
    tapers, lam = S.slepian(n, half)
    lag = np.subtract.outer(k, k)
    for i, t in enumerate(tapers):
        assert min(np.abs(t - vectors[:, i]).max(), np.abs(t + vectors[:, i]).max()) < 1e-10
        assert abs(lam[i] - t @ (2 * w * np.sinc(2 * w * lag)) @ t) < 1e-12
    assert len(tapers) == min(max(int(2 * half) - 1, 1), n)


def test_tapers_of_a_long_trace():
    """A recording's length in seconds, where a dense matrix would take over a terabyte."""
    tapers, lam = S.slepian(200_000)
    assert np.allclose(tapers @ tapers.T, np.eye(7), atol=1e-6)
    assert np.allclose(lam, S.slepian(2_000)[1], atol=1e-4)
    even, odd = tapers[::2], tapers[1::2]
    assert np.allclose(even, even[:, ::-1]) and np.allclose(odd, -odd[:, ::-1])
    assert [int((np.diff(np.sign(t[np.abs(t) > 1e-9])) != 0).sum()) for t in tapers] == list(range(7))


def test_tapers_by_definition_and_multitaper_by_hand():
    """Tapers against the eigenvectors of the concentration problem itself, the estimate against plain sums."""
    n, half = 48, 4.0
    w = half / n
    lag = np.subtract.outer(np.arange(n), np.arange(n))
    concentration = 2 * w * np.sinc(2 * w * lag)
    values, vectors = np.linalg.eigh(concentration)
    tapers, lam = S.slepian(n, half)
    for k in range(len(tapers)):
        assert abs(lam[k] - values[-1 - k]) < 1e-8
    best = vectors[:, -len(tapers):]
    assert np.allclose(best.T @ tapers.T @ tapers @ best, np.eye(len(tapers)), atol=1e-5)
    x = np.random.default_rng(5).standard_normal(n)
    f, p = S.multitaper(x, 10.0, half)
    keep = lam > 0.9
    c, t = x - x.mean(), np.arange(n)
    for i in (0, 3, 11, n // 2):
        eig = [abs(sum(c[j] * v[j] * np.exp(-2j * np.pi * i * j / n) for j in t)) ** 2 for v in tapers[keep]]
        s = (eig[0] + eig[1]) / 2
        for _ in range(2000):
            d = [np.sqrt(m) * s / (m * s + (1 - m) * x.var()) for m in lam[keep]]
            s = sum(a * a * e for a, e in zip(d, eig)) / sum(a * a for a in d)
        assert abs(p[i] - s / 10.0 * (1 if i in (0, n // 2) else 2)) < 1e-6 * max(1, s)


def test_wavelet_bank_by_definition():
    fs, f, c = 64.0, np.array([5.0, 9.0]), np.array([3.0, 4.0])
    x = np.random.default_rng(7).standard_normal(120)
    sigma = c / (2 * np.pi * f)
    length = int(6 * sigma.max() * fs) | 1
    t = np.arange(-length // 2, length // 2 + 1) / fs
    got = S.bank_power(x, f, fs, c)
    for i in range(2):
        w = np.exp(2j * np.pi * f[i] * t) * np.exp(-(t**2) / (2 * sigma[i] ** 2))
        w = w / np.sqrt(np.trapezoid(np.abs(w) ** 2, t))
        assert np.allclose(got[i], np.abs(np.convolve(x, w, "same")) ** 2)
    with pytest.raises(ValueError):
        S.bank_power(x[:20], f, fs, c)


def test_kernels_are_cached_without_effect():
    x, f = np.random.default_rng(8).standard_normal(300), np.array([4.0, 7.0])
    a = S.morlet_power(x, f, 100.0, S.cycles(f))
    b = np.array([np.abs(k) ** 2 for k in S.same_convolution(x, [S.morlet(v, 100.0, n) for v, n in zip(f, S.cycles(f), strict=True)])])
    assert np.allclose(a, b) and np.allclose(a, S.morlet_power(x, f, 100.0, S.cycles(f)))
