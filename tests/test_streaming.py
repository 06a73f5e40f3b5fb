"""Streams replayed from files against batch results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochlake.streaming.event_windows import window_means
from epochlake.streaming.normalized import merged_moments, stream_normalized_windows

START = pd.Timestamp("2024-01-01")


def replay(spark, rows, schema, path, parts):
    """Rows (in order of arrival) as a stream of so many files, one a batch."""
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def at(seconds):
    return (START + pd.Timedelta(microseconds=round(float(seconds) * 1e6))).to_pydatetime()


def run(df, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


def test_normalized_windows_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    samples = {s: np.round(np.sort(rng.uniform(0, 60, 150)), 3) for s in "ab"}
    values = {s: rng.standard_normal(150) * (1 + (s == "b")) + 5 for s in "ab"}
    events = [(s, k, float(e)) for s in "ab" for k, e in enumerate([0.5, 7.25, 7.5, 20.0, 41.125, 58.0])]
    arrival = sorted([(t + rng.uniform(0, 3), s, t, v) for s in "ab" for t, v in zip(samples[s], values[s], strict=True)])
    rows = [(s, at(t), float(v)) for _, s, t, v in arrival]
    ends = [(s, at(t), 0.0) for t in (500, 900, 1300) for s in "ab"]  # later samples move the watermark on
    stream = replay(spark, rows + ends, "subject string, ts timestamp, v double", tmp_path / "s", 9)
    triggers = replay(spark, [(s, k, at(e)) for s, k, e in events], "subject string, event_id long, ts timestamp", tmp_path / "e", 1)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(stream_normalized_windows(triggers, stream, 2.0, "100 seconds"), spark, "normalized", tmp_path)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    want = {}
    for s, k, e in events:
        t, v = samples[s], values[s]
        if e - 2 < t[0]:
            continue
        mu, sd = v[t < e + 2].mean(), v[t < e + 2].std()
        for x, y in zip(t, v, strict=True):
            if e - 2 <= x < e + 2:
                want[s, k, round(float(x), 3)] = (y - mu) / sd
    found = {(r["subject"], r["event_id"], round((pd.Timestamp(r["ts"]) - START).total_seconds(), 3)): r["z"] for r in got}
    assert found.keys() == want.keys() and len(got) == len(want) > 50
    for k, z in want.items():
        assert found[k] == pytest.approx(z, rel=1e-9, abs=1e-9)


def test_moments_are_merged_exactly():
    x = np.random.default_rng(0).standard_normal(1000) * 1e-3 + 1e6
    state = (0.0, 0.0, 0.0)
    for part in np.split(x, [1, 7, 400, 400]):
        state = merged_moments(*state, part)
    assert state[0] == 1000 and state[1] == pytest.approx(x.mean(), rel=1e-15) and np.sqrt(state[2] / 1000) == pytest.approx(x.std(), rel=1e-6)


def test_window_means_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], at(i * 0.7), float(rng.standard_normal())) for i in range(200)]
    stream = replay(spark, rows + [("a", at(1000), 0.0), ("a", at(2000), 0.0)], "subject string, ts timestamp, v double", tmp_path / "m", 6)
    got = {(r["subject"], r["window"]["start"]): (r["mean"], r["n"]) for r in run(window_means(stream), spark, "means", tmp_path)}
    batch = spark.createDataFrame(rows, "subject string, ts timestamp, v double").groupBy("subject", F.window("ts", "10 seconds")).agg(F.avg("v"), F.count("v"))
    want = {(r[0], r[1]["start"]): (pytest.approx(r[2]), r[3]) for r in batch.collect()}
    assert {k: v for k, v in got.items() if k in want} == want
