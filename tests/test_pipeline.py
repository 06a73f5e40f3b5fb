"""Composite analyses on synthetic recordings, sources and sinks, settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.config import AnalysisConfig, memory_estimate, resolve_region
from epochlake.functions.columns import axis_range, geometric_grid, select_frequencies
from epochlake.operators import averages, catalog, epochs, montage, normalize
from epochlake.operators import spectral as S
from epochlake.operators.spectral import cycles, morlet_power, spectra
from epochlake.plans import pipeline
from epochlake.sources import readers, sinks
from epochlake.sources.synthetic import synthetic_recordings

CONFIG = AnalysisConfig(n_freqs=5, freq_min=3, freq_max=8, window=2.0)


@pytest.fixture(scope="module")
def data(spark):
    s, e, m = synthetic_recordings(spark, seconds=40)
    return s.cache(), e.cache(), m.cache()


def by_numpy(data, config, region=(8, 6, 9)):
    """Per (subject, size): event-weighted mean window [f, k] and numbers of events."""
    s, e, m = (x.toPandas() for x in data)
    f = np.geomspace(config.freq_min, config.freq_max, config.n_freqs)
    out = {}
    for (subject, session), ev in e.groupby(["subject", "session"]):
        chans = m[(m.subject == subject) & m.electrode.isin(region)].channel_idx
        traces = s[(s.subject == subject) & (s.session == session) & s.channel_idx.isin(chans)]
        power = []
        for x in traces.samples:
            p = morlet_power(np.array(x), f, 200.0, cycles(f))
            power.append((p - p.mean(axis=1, keepdims=True)) / p.std(axis=1, keepdims=True))
        power = np.mean(power, axis=0)
        t = np.arange(power.shape[1]) / 200
        for size, g in ev.groupby("size"):
            cuts = [pipeline.window_slice(t, x, 1.0, 400) for x in g.t]
            w = np.array([power[:, c] for c in cuts if c is not None])
            b = w[:, :, axis_range(400, 1.0, -1.0, -0.5)].mean(axis=2)
            z = (w - b.mean(axis=0)[:, None]) / np.maximum(b.std(axis=0), 1e-12)[:, None]
            out.setdefault((subject, size), []).append(z)
    return out


def test_subject_analysis_matches_numpy(spark, data):
    regions = pipeline.region_table(spark, {"front": [8, 6, 9]})
    got = pipeline.analyze_subject(*data[:2], data[2], regions, CONFIG).where("k % 50 = 0").toPandas()
    want = by_numpy(data, CONFIG)
    assert set(zip(got.subject, got["size"], strict=True)) == set(want)
    for (subject, size), zs in want.items():
        mean = np.concatenate(zs).mean(axis=0)
        for r in got[(got.subject == subject) & (got["size"] == size)].itertuples():
            assert abs(r.z - mean[r.f_idx, r.k]) < 1e-8 * max(1, abs(mean[r.f_idx, r.k]))
            assert r.n_events == sum(map(len, zs)) and r.n_sessions == len(zs)


def test_session_weighting_and_population(spark, data):
    regions = pipeline.region_table(spark, {"front": [8, 6, 9]})
    config = AnalysisConfig(n_freqs=5, window=2.0, session_weighting="session")
    subjects = pipeline.analyze_subject(*data[:2], data[2], regions, config).where("k = 180 AND f_idx = 2").cache()
    want = {k: np.mean([z.mean(axis=0)[2, 180] for z in zs]) for k, zs in by_numpy(data, config).items()}
    got = {(r["subject"], r["size"]): r["z"] for r in subjects.collect()}
    assert all(abs(got[k] - v) < 1e-8 * max(1, abs(v)) for k, v in want.items())
    for r in pipeline.analyze_population(subjects).collect():
        assert abs(r["z"] - np.mean([v for (_, size), v in want.items() if size == r["size"]])) < 1e-6 * max(1, abs(r["z"]))


def test_theta_report_grows_with_size(spark, data):
    regions = pipeline.region_table(spark, {"front": "8,6,9"})
    subjects = pipeline.analyze_subject(*data[:2], data[2], regions, AnalysisConfig(n_freqs=5, window=2.0, normalization="channel_global"))
    power = {r["size"]: r["mean"] for r in pipeline.theta_report(subjects, CONFIG).collect()}
    assert power[1.0] < power[2.0] < power[3.0]
    with pytest.raises(ValueError):
        pipeline.theta_power(subjects, ["size"], AnalysisConfig(theta=(30.0, 31.0)))


def test_all_channels_are_one_query(spark, data):
    got = pipeline.analyze_all_channels(spark, *data, AnalysisConfig(n_freqs=2, window=2.0), range(6, 10)).where("k = 0 AND f_idx = 0 AND size = 1.0")
    assert {r["region"] for r in got.collect()} == {"6", "7", "8", "9"}


def test_baseline_means_are_zero(spark, data):
    regions = pipeline.region_table(spark, {"front": [8]})
    w = pipeline.session_windows(*data[:2], data[2], regions, CONFIG)
    b = w.select("session", "subject", "size", "f_idx", normalize.array_mean(F.col("w"), axis_range(400, 1.0, -1.0, -0.5)).alias("b"))
    assert b.groupBy("session", "subject", "size", "f_idx").agg(F.avg("b").alias("b")).agg(F.max(F.abs("b"))).first()[0] < 1e-6


def test_channel_analysis(spark):
    t = np.arange(2000) / 200
    df = spark.createDataFrame([(1, (2 * np.sin(2 * np.pi * 10 * t)).tolist())], "id int, w array<double>")
    for method in ("welch", "multitaper"):
        r = pipeline.analyze_channels(df, ["id"], 200.0, (1.0, 8.0), size=512, method=method).first()
        assert abs(r["peak_freq"] - 10) < 0.5 and abs(r["duration"] - 7.005) < 1e-9
        assert abs(r["alpha"] - 2) < 0.2 and r["gamma"] < 0.05 and abs(r["std"] - 2**0.5) < 0.01
    with pytest.raises(Exception, match="no sample"):
        pipeline.analyze_channels(df, ["id"], 200.0, (90.0, 91.0)).collect()


def test_chunked_power_differs_only_by_its_edges(spark):
    x = np.random.default_rng(2).standard_normal(400)
    df = spark.createDataFrame([(1, x.tolist())], "id int, w array<double>")
    from epochlake.operators.spectral import morlet_spectra

    whole, parts = (np.array(morlet_spectra(df, ["id"], [8.0], 100.0, chunk=c).first()["power"]) for c in (None, 200))
    assert len(parts) == 400 and np.allclose(whole[:100], parts[:100]) and not np.allclose(whole[180:220], parts[180:220])


def test_recordings_round_trip(spark, data, tmp_path):
    sinks.write_recordings(*data[:2], f"file://{tmp_path}/rec")
    s, e = readers.recordings(spark, f"file://{tmp_path}/rec")
    assert s.count() == data[0].count() and e.count() == data[1].count()
    assert readers.sessions_of(s, "r1").select("session").distinct().count() == 2
    assert readers.session_at(s, 2).select("subject").distinct().collect()[0][0] == "r1"
    with pytest.raises(ValueError):
        readers.sessions_of(s, "none")
    with pytest.raises(IndexError):
        readers.session_at(s, 99)


def test_command_line(spark, data, tmp_path):
    from epochlake.__main__ import parser, run, settings

    sinks.write_recordings(*data[:2], f"file://{tmp_path}/rec")
    (tmp_path / "m.csv").write_text("rat_id,ch_0,ch_1,ch_2,ch_3\n" + "".join(f"r{s},8,6,9,7\n" for s in range(3)))
    (tmp_path / "f.txt").write_text("8\n6\n4\n2.5\n")
    common = ["--data", f"file://{tmp_path}/rec", "--montage", f"file://{tmp_path}/m.csv", "--n-freqs", "3"]
    for mode, rows in (("session", 6 * 3 * 3 * 400), ("population", 3 * 3 * 400)):
        run(spark, [mode, *common, "--out", f"file://{tmp_path}/{mode}"])
        assert spark.read.parquet(f"file://{tmp_path}/{mode}").count() == rows
    texts = {r["session"]: r["value"].split("\n") for r in spark.read.text(f"file://{tmp_path}/session-texts", wholetext=True).where("subject = 'r1'").collect()}
    assert set(texts) == {"d0", "d1"}
    events = data[1].where("subject = 'r1' AND session = 'd0' AND t >= 1 AND t <= 38.9").groupBy("size").count().collect()
    want = ", ".join(f"{int(r['size'])}={r['count']}" for r in sorted(events))
    assert texts["d0"][:8] == ["session: r1_d0", "region: frontal", "channels: 3", "frequency_range: 3.0-8.0 Hz", "normalization: baseline_cross_event", "nm_sizes_analyzed: 1, 2, 3", f"events_per_size: {want}", f"total_events_analyzed: {sum(r['count'] for r in events)}"]
    run(spark, ["report", *common, "--freq-file", f"file://{tmp_path}/f.txt", "--freq-max", "7", "--out", f"file://{tmp_path}/report"])
    assert spark.read.json(f"file://{tmp_path}/report").count() == 3
    each, means = spark.read.json(f"file://{tmp_path}/report-subjects").toPandas(), spark.read.json(f"file://{tmp_path}/report").toPandas()
    assert len(each) == 9 and np.allclose(each.groupby("size").power.mean(), means.set_index("size")["mean"].sort_index())
    stats = spark.read.json(f"file://{tmp_path}/session-baseline").toPandas()
    assert len(stats) == 6 * 3 * 3 and (stats.sd > 0).all() and (stats.n_baseline_samples == len(axis_range(400, 1.0, -1.0, -0.5))).all()
    for flags, want in (([], 3), (["--every-second"], 2)):
        a = parser().parse_args(["report", *common, "--out", "x", "--freq-file", f"file://{tmp_path}/f.txt", "--freq-min", "4", "--freq-max", "8", "--exact-freqs", *flags])
        assert len(settings(spark, a).freqs) == want + (not flags)
    run(spark, ["summary", *common[:2], "--subject", "r1", "--out", f"file://{tmp_path}/summary"])
    got = spark.read.parquet(f"file://{tmp_path}/summary").collect()
    assert {(r["length"], r["n_channels"]) for r in got} == {(8000, 4)} and len(got) == 2
    report = spark.read.json(f"file://{tmp_path}/session-summary").first()
    assert (report["n_subjects"], report["n_sessions"], report["n_traces"], report["n_failed"], report["warnings"]) == (3, 6, 18, 0, []) and "freq_min" in report["settings"]
    assert spark.read.text(f"file://{tmp_path}/session-failures").count() == 0
    run(spark, ["subject", *common, "--freq-file", f"file://{tmp_path}/f.txt", "--freq-max", "7", "--exact-freqs", "--out", f"file://{tmp_path}/exact"])
    assert {r["freq"] for r in spark.read.parquet(f"file://{tmp_path}/exact").select("freq").distinct().collect()} == {8.0, 6.0, 4.0, 2.5}
    assert catalog.checked_channels(data[0], [0, 3]).count() == 12
    for bad in ([], [-1], [4]):
        with pytest.raises(ValueError):
            catalog.checked_channels(data[0], bad)


def test_results_and_summaries(spark, data, tmp_path):
    rows = spark.createDataFrame([("r1", "d1", 1.0), ("r1", "d2", 2.0)], "subject string, session string, z double")
    sinks.write_results(rows, f"file://{tmp_path}/res")
    sinks.write_results(rows.where("session = 'd1'").withColumn("z", F.lit(5.0)), f"file://{tmp_path}/res")
    assert sorted(r["z"] for r in readers.results(spark, f"file://{tmp_path}/res", ["z"]).collect()) == [2.0, 5.0]
    with pytest.raises(ValueError):
        readers.results(spark, f"file://{tmp_path}/res", ["power"])
    bare = spark.createDataFrame([("r2", "d1", 7)], "subject string, session string, other int")
    bare.write.mode("append").partitionBy("subject", "session").parquet(f"file://{tmp_path}/res")
    got = readers.results(spark, f"file://{tmp_path}/res", ["z"], skip=True)
    assert sorted((r["subject"], r["z"]) for r in got.collect()) == [("r1", 2.0), ("r1", 5.0)]
    with pytest.raises(ValueError):
        readers.results(spark, f"file://{tmp_path}/res", ["power"], skip=True)
    assert [tuple(r) for r in sinks.subject_index(rows).collect()] == [(1, "r1")]
    many = spark.createDataFrame([(f"r{i % 40}",) for i in range(200)] + [(None,)], "subject string").repartition(7)
    assert sorted(map(tuple, sinks.subject_index(many).collect())) == list(enumerate(sorted({f"r{i}" for i in range(40)}), 1))
    assert sinks.subject_index(many.where("subject = 'x'")).count() == 0
    p = spark.createDataFrame([("d1", "r1", "8", 1, 0.5), ("d1", "r1", "8", 3, -0.25)], "session string, subject string, electrode string, size int, power double")
    sinks.write_theta_csv(p, [1, 2, 3], f"file://{tmp_path}/csv")
    assert {r[0] for r in spark.read.text(f"file://{tmp_path}/csv").collect()} == {"session_number;rat_ID;electrode_number;NM_size1;NM_size2;NM_size3", "d1;r1;8;0.500000;nan;-0.250000"}
    sinks.write_json(p, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "f.txt").write_text("7.5\n\nabc\n3.25\n")
    assert sorted(r[0] for r in readers.frequency_text(spark, f"file://{tmp_path}/f.txt").collect()) == [3.25, 7.5]
    (tmp_path / "empty.txt").write_text("x\n")
    with pytest.raises(ValueError):
        readers.frequency_text(spark, f"file://{tmp_path}/empty.txt")
    (tmp_path / "m.csv").write_text("rat_id,ch_0,ch_1\n7,10,11\n8,12,None\n")
    assert sorted(map(tuple, readers.montage_csv(spark, f"file://{tmp_path}/m.csv").collect())) == [("7", 0, 10), ("7", 1, 11), ("8", 0, 12)]
    assert spark.range(1).select(readers.decode_chars(F.array(F.lit(72), F.lit(0), F.lit(105)))).first()[0] == "Hi"
    (tmp_path / "bad.mat").write_bytes(b"none")
    assert readers.mat_sessions(spark, f"file://{tmp_path}/*.mat").first()["error"]
    maps = spark.createDataFrame([("7", [10, 11, 12]), ("8", [13])], "subject string, map array<int>")
    sinks.write_montage_csv(maps, f"file://{tmp_path}/maps")
    assert sorted(map(tuple, readers.montage_csv(spark, f"file://{tmp_path}/maps").collect())) == [("7", 0, 10), ("7", 1, 11), ("7", 2, 12), ("8", 0, 13)]


def test_session_files_to_recordings(spark, tmp_path):
    (tmp_path / "bad.mat").write_bytes(b"none")
    broken = readers.mat_sessions(spark, f"file://{tmp_path}/bad.mat")
    good = [("p", "r1", "d1", [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], [0.5, 0.505, 0.51, 0.515], [9.0, 8.0], [0.5, 0.6], [0.505], [2.0], [0.51], [1.0], None), ("q", "r2", "d1", [[1.0]], [0.0], [], [], [], [], [], [], None)]
    signals, events, velocity, failures = readers.mat_recordings(broken.unionByName(spark.createDataFrame(good, broken.schema)))
    sinks.write_recordings(signals, events, f"file://{tmp_path}/rec")
    s, e = readers.recordings(spark, f"file://{tmp_path}/rec")
    s, e = s.select(signals.columns), e.select(events.columns)
    assert sorted(map(tuple, s.collect())) == [("r1", "d1", 0, 200.0, 0.5, [1.0, 2.0, 3.0, 4.0]), ("r1", "d1", 1, 200.0, 0.5, [5.0, 6.0, 7.0, 8.0]), ("r2", "d1", 0, 200.0, 0.0, [1.0])]
    assert sorted(map(tuple, e.select("subject", "session", "event_idx", "kind", "t", "size").collect())) == [("r1", "d1", 0, "iti", 0.51, 1.0), ("r1", "d1", 0, "nm", 0.505, 2.0)]
    at = {r["kind"]: r["v"] for r in pipeline.velocity_at_events(velocity, e).collect()}
    assert at == {"nm": 9.0, "iti": 9.0}
    assert [r["path"].endswith("bad.mat") for r in failures.collect()] == [True]


def test_grids(spark):
    g = geometric_grid(spark, 3.0, 8.0, 20).orderBy("f_idx").toPandas()
    assert np.allclose(g.freq, np.geomspace(3, 8, 20)) and g.freq.iloc[-1] == 8.0
    assert geometric_grid(spark, 3.0, 8.0, 1).first()["freq"] == 3.0
    f = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.5, 6.0, 8.0, 9.0)], "freq double")
    assert sorted(r[0] for r in select_frequencies(f, 3, 7, True).collect()) == [2.0, 3.5, 6.0, 8.0]
    assert sorted(r[0] for r in select_frequencies(f, 0.5, 99, True).collect()) == [1.0, 2.0, 3.5, 6.0, 8.0, 9.0]


def test_montages(spark):
    wide = spark.createDataFrame([("a", 8, 6, None), ("b", 9, 11, 8)], "subject string, ch_0 int, ch_1 int, ch_2 int")
    m = montage.unpivot_montage(wide, "subject")
    r = spark.createDataFrame([("front", 8), ("front", 9), ("none", 30)], "region string, electrode int")
    assert {(x["subject"], x["region"]): x["channels"] for x in montage.region_catalog(m, r).collect()} == {("a", "front"): [0], ("b", "front"): [0, 2]}
    assert {(x["subject"], x["region"]): x["compatible"] for x in montage.compatibility(m, r).collect()} == {("a", "front"): False, ("b", "front"): True, ("a", "none"): False, ("b", "none"): False}
    assert {tuple(x) for x in montage.missing_electrodes(m, r).collect()} == {("a", "front", 9), ("a", "none", 30), ("b", "none", 30)}
    assert montage.electrodes_of(m, spark.createDataFrame([("a", 1), ("a", 9)], "subject string, channel_idx int")).collect()[0]["electrode"] == 6
    p = spark.createDataFrame([("a", [1, 2]), ("a", [1, 2]), ("b", [1, 2]), ("b", [2, 1]), ("c", [1])], "subject string, map array<int>")
    assert [tuple(x) for x in montage.consistent_montage(p, 2).collect()] == [("a", [1, 2])]
    s = spark.createDataFrame([("a", "x"), ("a", "y")], "subject string, session_date string")
    assert {x["session_date"]: x["montage_subject"] for x in montage.session_montage(s, {("a", "x"): "b"}).collect()} == {"x": "b", "y": "a"}


@pytest.mark.parametrize("spec,ok", [("8,16,24", True), ("frontal", True), ("hippocampus", False), ([8, 16, 24], True), ("8", True), (8, False), ([0, 1], False)])
def test_region_specs(spec, ok):
    if ok:
        assert all(1 <= e <= 32 for e in resolve_region(spec))
    else:
        with pytest.raises(ValueError):
            resolve_region(spec)


def test_settings():
    for bad in ({"freq_min": 9.0}, {"cycles": "x"}, {"normalization": "x"}, {"baseline": (-2.0, -1.5)}, {"session_weighting": "x"}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)
    assert CONFIG.samples == 400 and CONFIG.summary()["n_freqs"] == 5
    assert memory_estimate(240, 474_506, 3) == 240 * 474_506 * 16 * 3 * 3


def test_error_rows_and_edges(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "id int, w array<double>")
    out = {r["id"]: r["error"] for r in spectra(t, lambda x: (np.array([1.0]), x[None, :]), ["id"]).collect()}
    assert out[1] is None and "empty" in out[2]
    one = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert averages.mean_and_error(one, ["k"], "v").first()["se"] is None
    w = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, w array<double>")
    assert w.select(epochs.trim_or_pad(F.col("w"), 6)).first()[0] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    assert w.select(epochs.trim_or_pad(F.col("w"), 2)).first()[0] == [1.0, 2.0]
    assert w.select(epochs.pad_end(F.col("w"), 5)).first()[0] == [1.0, 2.0, 3.0, 3.0, 3.0]
    stats = normalize.baseline_statistics(spark.createDataFrame([(1, [2.0] * 64)], "id int, w array<double>"), ["id"], 64, 1.0, (-1.0, -0.5)).first()
    assert stats["sd"] == 1e-12 and stats["warnings"] == ["few_events", "tiny_std"]
    runs = spark.createDataFrame([("a", True), ("a", False)], "k string, ok boolean")
    assert catalog.failure_report(runs, ["k"]).first()["success_rate"] == 50.0
    assert catalog.missing_partitions(runs, runs.where("ok"), ["k", "ok"]).count() == 1


def test_streaming_windows(spark, tmp_path):
    from epochlake.streaming.event_windows import stream_event_windows

    rows = [("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(20)]
    spark.createDataFrame(rows, "subject string, ts string, v double").select("subject", F.to_timestamp("ts").alias("ts"), "v").write.parquet(f"file://{tmp_path}/s")
    spark.createDataFrame([("a", 1, "2024-01-01 00:00:10")], "subject string, event_id int, ts string").select("subject", "event_id", F.to_timestamp("ts").alias("ts")).write.parquet(f"file://{tmp_path}/e")
    s = spark.readStream.schema("subject string, ts timestamp, v double").parquet(f"file://{tmp_path}/s")
    e = spark.readStream.schema("subject string, event_id int, ts timestamp").parquet(f"file://{tmp_path}/e")
    q = stream_event_windows(e, s, "2 seconds").writeStream.format("memory").queryName("win").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted(r["v"] for r in spark.sql("SELECT v FROM win").collect()) == [8.0, 9.0, 10.0, 11.0]
    finally:
        q.stop()


def test_failed_traces_are_reported(spark, data):
    bad = (F.col("channel_idx") == 1) & (F.col("session") == "d0")
    signals = data[0].withColumn("samples", F.when(bad, F.array().cast("array<double>")).otherwise(F.col("samples")))
    regions = pipeline.region_table(spark, {"front": [8, 6, 9]})
    spectra = pipeline.event_spectra(pipeline.region_signals(signals, data[2], regions, CONFIG), data[1], CONFIG).cache()
    assert {tuple(r)[1:3] for r in S.failures(spectra, ["subject", "session", "channel_idx"]).collect()} == {("d0", 1)}
    assert {(r["session"], r["n"], r["n_failed"]) for r in pipeline.processing_report(spectra).collect()} == {("d0", 3, 1), ("d1", 3, 0)}
    got = pipeline.analyze_session(signals, data[1], data[2], regions, CONFIG, spectra).select("session", "n_channels").distinct().collect()
    assert {tuple(r) for r in got} == {("d0", 2), ("d1", 3)}
    some = spark.createDataFrame([("r0", 0, 8), ("r1", 0, 8), ("r1", 1, 6), ("r1", 2, 9)], "subject string, channel_idx int, electrode int")
    assert {r["subject"] for r in pipeline.eligible(signals, some, regions).select("subject").distinct().collect()} == {"r1"}


@pytest.mark.parametrize("width", [0.7, 4.0, 1e9, None])
def test_nearest_samples_and_windows_in_any_buckets(spark, width):
    rng = np.random.default_rng(6)
    samples, events = [], []
    for key in "ab":
        t = np.unique(rng.integers(0, 4000, 90)) / 100.0
        t = t[(t < 8) | (t > 25)]  # a gap of many buckets
        samples += [(key, float(x), float(i)) for i, x in enumerate(t)]
        events += [(key, i, float(x)) for i, x in enumerate(rng.integers(-500, 4500, 30) / 100.0)]
    s = spark.createDataFrame([*samples, ("c", 1.0, 0.0)], "subject string, t double, v double")
    e = spark.createDataFrame([*events, ("none", 1, 3.0)], "subject string, event_id int, e double")
    near, cut = {}, {}
    for key, i, x in events:
        own = [(a, v) for k, a, v in samples if k == key]
        best = min(range(len(own)), key=lambda j: (abs(own[j][0] - x), own[j][0]))
        near[key, i] = own[best]
        first = max(best - 5 // 2, 0)
        if first + 5 <= len(own):
            cut |= {(key, i, k): own[first + k] for k in range(5)}
    got = epochs.nearest_sample(e, s, ["subject"], width).collect()
    assert {(r["subject"], r["event_id"]): (r["t"], r["v"]) for r in got} == near
    got = epochs.nearest_windows(e, s, 5, ["subject"], width).collect()
    assert {(r["subject"], r["event_id"], r["k"]): (r["t"], r["v"]) for r in got} == cut and len(got) == len(cut)
    steps = {r["subject"]: r["interval"] for r in epochs.sampling_interval(s, ["subject"], width).collect()}
    assert abs(steps["a"] - np.median(np.diff([a for k, a, _ in samples if k == "a"]))) < 1e-9 and steps["c"] is None


@pytest.mark.parametrize("sent", [epochs.MOST_SENT, 0])
def test_bursts_are_cut_again(spark, monkeypatch, sent):
    """Most samples of one recording lie in a thousandth of its time: no bucket holds them all, and no result changes."""
    monkeypatch.setattr(epochs, "MOST_SENT", sent)
    rng = np.random.default_rng(7)
    t = np.unique(np.concatenate([rng.uniform(0, 1000, 100), rng.uniform(500, 501, 900)]))
    rows = [("a", float(x), float(i)) for i, x in enumerate(t)] + [("b", float(x), float(x)) for x in range(0, 1000, 50)] + [("a", None, 5.0)]
    s = spark.createDataFrame(rows, "subject string, t double, v double")
    at = [(k, i, float(x)) for k in "ab" for i, x in enumerate(np.concatenate([rng.uniform(-10, 1010, 40), rng.uniform(499.9, 501.1, 40)]))]
    e = spark.createDataFrame([*at, ("a", 99, None)], "subject string, edges int, e double")
    cuts = epochs.time_cuts(s, ["subject"], None, 20)
    assert cuts.edges is not None and cuts.few == (sent > 0)
    held = cuts.of(s, F.col("t")).groupBy("subject", "bucket").agg(F.count("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("subject", "bucket").collect()
    assert max(r["n"] for r in held) <= 60 and sum(r["n"] for r in held) == len(rows) - 1
    assert all(x["hi"] < y["lo"] for x, y in zip(held, held[1:]) if x["subject"] == y["subject"])  # buckets are in order of time
    got = {(r["subject"], r["edges"]): r["t"] for r in epochs.nearest_sample(e, s, ["subject"], None, 20).collect()}
    assert got == {(k, i): min((y for o, y, _ in rows if o == k and y is not None), key=lambda y: (abs(y - x), y)) for k, i, x in at}
    numbers = epochs.numbered_samples(s, ["subject"], None, 20).where("subject = 'a'").collect()
    assert len(numbers) == len(t) and all(r["i"] == r["v"] for r in numbers)
    windows = epochs.nearest_windows(e, s, 5, ["subject"], None, 20).where("subject = 'a'").collect()
    place = {x: i for i, x in enumerate(t)}
    first = {i: max(place[got["a", i]] - 2, 0) for k, i, _ in at if k == "a"}
    want = {(i, k): float(f + k) for i, f in first.items() if f + 5 <= len(t) for k in range(5)}
    assert {(r["edges"], r["k"]): r["v"] for r in windows} == want and len(windows) == len(want)
    steps = {r["subject"]: (r["interval"], r["n"]) for r in epochs.sampling_interval(s, ["subject"], None, 20).collect()}
    assert steps["a"][1] == len(t) - 1 and abs(steps["a"][0] - np.median(np.diff(t))) < 1e-12 and steps["b"] == (50.0, 19)


def test_even_recordings_are_not_cut_again(spark):
    s = spark.range(1000).select(F.lit("a").alias("subject"), F.col("id").cast("double").alias("t"), F.lit(0.0).alias("v"))
    assert epochs.time_cuts(s, ["subject"], None, 20).edges is None


def test_baseline_without_samples(spark):
    w = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, w array<double>")
    with pytest.raises(ValueError):
        normalize.baseline_per_event(w, 3, 1.0, (-0.9, -0.8))
    stats = spark.createDataFrame([(1, 1.0, 2.0)], "id int, mu double, sd double")
    assert normalize.baseline_per_event(w, 3, 1.0, (-0.9, -0.8), stats, ["id"]).first()["w"] == [0.0, 0.5, 1.0]
