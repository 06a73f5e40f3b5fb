"""Seeded synthetic recordings with a known effect, for tests and demonstrations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .readers import EVENTS, SIGNALS


def synthetic_recordings(spark: SparkSession, subjects: int = 3, sessions: int = 2, channels: int = 4, seconds: int = 60, fs: float = 200.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, events, montage): smoothed noise plus a 5 Hz burst of amplitude size in [-0.3, 0.1] s of each event.

    Of the events of a session one lies too close to each end; the number of the others differs between sessions.
    """
    rng = np.random.default_rng(seed)
    sig, ev = [], []
    t = np.arange(int(seconds * fs)) / fs
    for s in range(subjects):
        for d in range(sessions):
            count = 6 + 3 * d + s
            times = np.sort(rng.choice(np.arange(2, seconds - 3, 1.5), count, replace=False))
            sizes = [1 + i % 3 for i in range(count)]
            rows = [(0.2, 1.0), *zip(times.tolist(), map(float, sizes), strict=True), (seconds - 0.3, 2.0)]
            ev += [(f"r{s}", f"d{d}", i, "nm", float(e), z) for i, (e, z) in enumerate(rows)]
            for c in range(channels):
                x = np.convolve(rng.standard_normal(len(t)), np.ones(8) / 8, "same")
                for e, z in rows:
                    m = (t >= e - 0.3) & (t <= e + 0.1)
                    x[m] += z * np.sin(2 * np.pi * 5 * (t[m] - e))
                sig.append((f"r{s}", f"d{d}", c, fs, 0.0, x.tolist()))
    montage = [(f"r{s}", c, e) for s in range(subjects) for c, e in enumerate([8, 6, 9, 7][:channels])]
    return spark.createDataFrame(sig, SIGNALS), spark.createDataFrame(ev, EVENTS), spark.createDataFrame(montage, "subject string, channel_idx int, electrode int")
