"""Recordings in blocks against whole recordings."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.config import AnalysisConfig
from epochlake.operators import blocks, epochs
from epochlake.operators.spectral import cycles, morlet_power
from epochlake.plans import pipeline
from epochlake.sources.synthetic import synthetic_recordings

CONFIG = AnalysisConfig(freq_min=3.0, freq_max=8.0, n_freqs=5, window=1.0, baseline=(-0.5, -0.25), normalization="channel_global")


@pytest.fixture(scope="module")
def data(spark):
    signals, events, montage = synthetic_recordings(spark, subjects=2, sessions=1, channels=2, seconds=25)
    return pipeline.region_signals(signals, montage, pipeline.region_table(spark, {"f": [8, 6]}), CONFIG).cache(), events.cache()


def rows(df):
    return {(r["subject"], r["session"], r["channel_idx"], r["event_idx"], r["f_idx"]): r for r in df.collect()}


def split(signals, length):
    """Whole recordings as stored pieces of a length."""
    n = F.size("samples")
    start = F.explode(F.sequence(F.lit(0), n - 1, F.lit(length))).alias("start")
    return signals.select("*", start).withColumn("samples", F.slice("samples", F.col("start") + 1, F.lit(length))).withColumn("start", F.col("start").cast("long"))


@pytest.mark.parametrize("size,pieces,raw,budget", [(30_000, None, False, 1 << 28), (97, None, False, 1 << 28), (700, 333, False, 1 << 28), (1000, 41, True, 1 << 28), (4000, None, False, 60_000)])
def test_blocks_give_the_spectra_of_whole_recordings(data, size, pieces, raw, budget):
    signals, events = data
    config = AnalysisConfig(freq_min=3.0, freq_max=8.0, n_freqs=5, window=1.0, baseline=(-0.5, -0.25), baseline_input="raw") if raw else CONFIG
    want = rows(pipeline.event_spectra(signals, events, config))
    got = rows(blocks.event_spectra(signals if pieces is None else split(signals, pieces), events, config, size=size, budget=budget))
    assert got.keys() == want.keys() and len(got) > 50
    for k, r in got.items():
        assert r["error"] is None and (r["size"], r["freq"], r["regions"]) == (want[k]["size"], want[k]["freq"], want[k]["regions"])
        np.testing.assert_allclose(r["w"], want[k]["w"], rtol=1e-9, atol=1e-9)
        assert r["attempts"] == 1 if budget > 1e6 else r["attempts"] > 1


def test_moments_of_power_lose_no_digits(data):
    signals, _ = data
    flat = signals.withColumn("samples", F.transform("samples", lambda x, i: F.sin(2 * np.pi * 5 * i / 200) * 1e4 + x * 1e-3))
    f = np.array(CONFIG.grid())
    for r in blocks.spectral_moments(flat, CONFIG, size=450).join(flat, blocks.CHANNEL).collect():
        p = morlet_power(np.array(r["samples"]), f, 200.0, cycles(f))
        assert r["n"] == len(r["samples"])
        np.testing.assert_allclose(r["mu"], p.mean(axis=1), rtol=1e-9)
        np.testing.assert_allclose(r["sd"], p.std(axis=1), rtol=1e-9)


def test_bad_recordings_are_rows(data):
    signals, events = data
    cut = split(signals, 500)
    hole = cut.where("NOT (subject = 'r0' AND channel_idx = 1 AND start = 1500)")
    out = blocks.event_spectra(hole, events, CONFIG, size=500)
    errors = {(r["subject"], r["channel_idx"]): r["error"] for r in out.where("error IS NOT NULL").collect()}
    assert set(errors) == {("r0", 1)} and "missing" in errors["r0", 1]
    assert out.where("error IS NULL AND subject = 'r0' AND channel_idx = 1").count() == 0
    tiny = blocks.event_spectra(signals, events, CONFIG, size=4000, budget=1000)
    assert {r["error"].split(":")[0] for r in tiny.collect()} == {"MemoryError"}
    assert blocks.event_spectra(signals.where("subject = ''"), events, CONFIG).count() == 0


@pytest.mark.parametrize("width", [0.4, 1.0, 3.7, 1000.0])
def test_block_windows_are_the_windows_of_samples(spark, width):
    rng = np.random.default_rng(1)
    samples = [(s, float(t), float(i)) for s in "ab" for i, t in enumerate(np.sort(rng.uniform(-5, 20, 400)).round(2))]
    events = [(s, k, float(e)) for s in "abc" for k, e in enumerate(rng.uniform(-6, 21, 60).round(1))]
    s = spark.createDataFrame(samples, "subject string, t double, v double")
    e = spark.createDataFrame(events, "subject string, event_id int, e double")
    want = sorted(map(tuple, epochs.event_windows(epochs.bounded_events(e, s, 0.5, ["subject"]), s, 0.5, ["subject"]).select("subject", "event_id", "t", "v").collect()))
    got = blocks.block_windows(e, blocks.time_blocks(s, ["subject"], width), 0.5, ["subject"], width)
    assert sorted(map(tuple, got.select("subject", "event_id", F.inline("s")).collect())) == want and want
    each = got.select(F.col("s.t").alias("t")).collect()
    assert all(list(r["t"]) == sorted(r["t"]) for r in each)


def test_fast_sizes():
    for n in (1, 2, 7, 97, 1000, 30_000, 32_001):
        size = blocks.fast_size(n)
        assert size >= n and size <= 1.15 * n + 1
        for p in (2, 3, 5):
            while size % p == 0:
                size //= p
        assert size == 1


def test_memory_of_a_long_recording():
    """240 frequencies of 474,506 samples, block by block and in the whole, within 400 MB above what is there before."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
import numpy as np
from epochlake.operators import blocks, spectral
f = np.geomspace(1, 45, 240)
x = np.random.default_rng(0).standard_normal(474_506)
c = spectral.cycles(f)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
bank = blocks.Wavelets(f, 200.0, c)
blocks.moments(bank, x[:31_000], 0, 30_000, blocks.BUDGET)
total = sum(float(p.sum()) for _, p in zip(range(12), spectral.wavelet_rows("morlet", x, f, 200.0, c)))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400
