"""Operators that no registered query exercises."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.config import cycles_factor
from epochlake.functions.columns import select_frequencies
from epochlake.operators import averages, catalog, montage, spectral
from epochlake.plans import pipeline


def test_overlay_power_density(spark):
    t = np.arange(4096) / 200
    x = 50 * np.sin(2 * np.pi * 10 * t)
    rows = spectral.overlay_psd(spark.createDataFrame([(1, x.tolist())], "id int, w array<double>"), ["id"], 200.0, size=512).collect()
    f, p = spectral.welch(x * 1e-6, 200.0, 512)
    keep = (f >= 1) & (f <= 90)
    assert [r["freq"] for r in sorted(rows, key=lambda r: r["freq"])] == f[keep].tolist()
    np.testing.assert_allclose([r["p"] for r in sorted(rows, key=lambda r: r["freq"])], p[keep], rtol=1e-9)


def test_plain_frequency_selection(spark):
    f = spark.createDataFrame([(x,) for x in (1.0, 3.0, 4.5, 7.0, 7.1)], "freq double")
    assert sorted(r[0] for r in select_frequencies(f, 3.0, 7.0).collect()) == [3.0, 4.5, 7.0]
    assert sorted(r[0] for r in select_frequencies(f, 3.0, 7.0, extended=True).collect()) == [1.0, 3.0, 4.5, 7.0, 7.1]


def test_cycles_factor():
    assert (cycles_factor("fixed", 0.7), cycles_factor("adaptive", 0.7), cycles_factor("hybrid")) == (0.1, 0.7, 1.0)


def test_compatible_results(spark):
    df = spark.createDataFrame([("a", 200.0, [3.0]), ("a", 100.0, [3.0])], "method string, fs double, freqs array<double>")
    assert tuple(catalog.compatible(df, ["method", "fs", "freqs"]).first()) == (True, False, True)


def test_recording_statistics(spark):
    x = np.random.default_rng(0).standard_normal(500)
    signals = spark.createDataFrame([("r", "d", 0, 200.0, 0.0, x.tolist()), ("r", "d", 1, 200.0, 0.0, [2.0] * 10)], "subject string, session string, channel_idx int, fs double, t0 double, samples array<double>")
    a, b = sorted(pipeline.recording_statistics(signals).collect(), key=lambda r: r["channel_idx"])
    np.testing.assert_allclose(tuple(a)[3:], (x.mean(), x.std(), x.min(), x.max(), 2.5))
    assert (b["mean"], b["std"], b["duration"]) == (2.0, pytest.approx(1e-12), 0.05)


def test_window_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i % 2, 3 - i % 3, rng.standard_normal(4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, s int, n_channels long, w array<double>").repartition(3)
    want = {}
    for g, s, c, w in rows:
        t, n, m = want.get((g, s), (np.zeros(4), 0, 9))
        want[g, s] = t + w, n + 1, min(m, c)
    got = averages.cell_sums(df, ["g", "s"]).collect()
    assert len(got) == 4 * len(want)
    for r in got:
        t, n, m = want[r["g"], r["s"]]
        assert r["total"] == pytest.approx(t[r["k"]]) and (r["n_events"], r["n_channels"]) == (n, m)
    assert averages.cell_sums(df.where("s > 5"), ["g", "s"]).count() == 0


def test_missing_electrodes(spark):
    m = spark.createDataFrame([("a", 0, 8), ("a", 1, 6), ("b", 0, 8)], "subject string, channel_idx int, electrode int")
    regions = spark.createDataFrame([("x", 8), ("x", 6), ("y", 8), ("z", 30)], "region string, electrode int")
    assert sorted(map(tuple, montage.missing_electrodes(m, regions).collect())) == [("a", "z", 30), ("b", "x", 6), ("b", "z", 30)]
    assert {(r["subject"], r["region"]): (r["n_missing"], r["compatible"]) for r in montage.compatibility(m, regions).collect()} == {("a", "x"): (0, True), ("a", "y"): (0, True), ("a", "z"): (1, False), ("b", "x"): (1, False), ("b", "y"): (0, True), ("b", "z"): (1, False)}
    assert montage.compatibility(m, regions.where("region = ''")).count() == 0


def test_session_description(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), (None, 9), ("b", 5)], "subject string, length long")
    got = {(r["subject"], r["all"]): (r["n"], r["min"], r["p50"], r["max"], r["std"]) for r in catalog.describe_sessions(s, ["length"]).collect()}
    assert got[None, True][:4] == (5, 1.0, 4.0, 9.0) and got["a", False] == (3, 1.0, 2.0, 4.0, pytest.approx(np.std([1, 2, 4], ddof=1)))
    assert got[None, False][:2] == (1, 9.0) and got["b", False][4] is None and len(got) == 4


def test_fourier_power_at_frequencies_of_the_row(spark):
    rng, fs = np.random.default_rng(8), 50.0
    rows = [(i, [float(x) for x in rng.normal(size=n)], f) for i, (n, f) in enumerate([(64, 3.0), (63, 7.5), (1, 4.0), (200, 20.0)])]
    rows += [(90, [], 3.0), (91, None, 3.0), (92, [1.0, None, 2.0], 3.0)]
    df = spark.createDataFrame(rows, "i int, w array<double>, f double")
    got = {r["i"]: r["p"] for r in df.select("i", spectral.fourier_power_at(F.col("w"), F.col("f"), fs).alias("p")).collect()}
    for i, x, freq in rows[:4]:
        assert np.isclose(got[i], abs((np.array(x) * np.exp(-2j * np.pi * freq * np.arange(len(x)) / fs)).sum()) ** 2, rtol=1e-9, atol=1e-12)
    assert got[90] == 0.0 and got[91] is None and got[92] is None


@pytest.mark.parametrize("cached", [spectral.CACHED_BYTES, 0])
def test_centre_power(spark, monkeypatch, cached):
    monkeypatch.setattr(spectral, "CACHED_BYTES", cached)
    rng, f, fs = np.random.default_rng(9), np.array([3.0, 7.5, 20.0]), 50.0
    for n in (1, 2, 63, 64, 500):
        x, t, c = rng.normal(size=n), (np.arange(n) - n // 2) / fs, np.array([5.0, 3.0, 1.5])
        g = np.exp(-(t**2) / (2 * (c / (2 * np.pi * f))[:, None] ** 2))
        want = np.abs((x * g * np.exp(-2j * np.pi * f[:, None] * t)).sum(axis=1) / g.sum(axis=1)) ** 2
        assert np.allclose(spectral.centre_power(x, f, fs, c), want, rtol=1e-9, atol=1e-15)
    t = np.arange(-200, 200) / 200
    p = spectral.centre_power(3 * np.sin(2 * np.pi * 8 * t + 1), np.array([4.0, 8.0, 16.0]), 200.0, np.full(3, 6.0))
    assert abs(p[1] - 9 / 4) < 0.01 and max(p[0], p[2]) < 0.01  # half the amplitude, squared


def test_centre_spectra_by_policy(spark):
    rows = [(1, [float(k % 7) for k in range(40)]), (2, []), (3, None)]
    out = spectral.centre_spectra(spark.createDataFrame(rows, "i int, w array<double>"), ["i"], [3.0, 8.0], 50.0, ["fixed", "custom"]).collect()
    got = {(r["i"], r["freq"]): r["power"] for r in out if r["error"] is None}
    assert set(got) == {(1, 3.0), (1, 8.0)} and {r["i"] for r in out if r["error"]} == {2, 3}
    for j, c in enumerate((5.0, 3.0)):
        want = spectral.centre_power(np.array(rows[0][1]), np.array([3.0, 8.0]), 50.0, np.array([c, c]))
        assert np.allclose([got[1, 3.0][j], got[1, 8.0][j]], want)
