"""Analyses that go on where they stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.config import AnalysisConfig
from epochlake.plans import pipeline, resume
from epochlake.sources import sinks
from epochlake.sources.synthetic import synthetic_recordings

CONFIG = AnalysisConfig(freq_min=4.0, freq_max=7.0, n_freqs=2, window=0.5, baseline=(-0.25, -0.1))
REGIONS = {"front": [8, 6]}


@pytest.fixture(scope="module")
def data(spark):
    signals, events, montage = synthetic_recordings(spark, subjects=3, sessions=2, channels=3, seconds=25)
    return signals.cache(), events.cache(), montage, pipeline.region_table(spark, REGIONS)


def runs(spark, folder, name):
    return {r["run"] for r in spark.read.parquet(f"{folder}/{name}").select("run").distinct().collect()}


def by_key(df):
    return {(r["subject"], r["size"], r["f_idx"], r["k"]): (r["z"], r["n_events"], r["n_sessions"], r["n_channels"], r["t"]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("weighting,block", [("event", None), ("session", 700)])
def test_only_what_is_pending_is_worked_out(spark, data, tmp_path, weighting, block):
    from dataclasses import replace

    config = replace(CONFIG, session_weighting=weighting)
    signals, events, montage, regions = data
    folder, name = f"file://{tmp_path}/states", resume.analysis_id(config, REGIONS)
    first = signals.where("NOT (subject = 'r1' AND session = 'd1')")
    update = lambda s, **more: resume.update_subjects(s, events, montage, regions, config, folder, name, block=block, **more)
    got = by_key(update(first))
    same(got, by_key(pipeline.analyze_subject(first, events, montage, regions, config)))
    before = runs(spark, folder, "states")
    assert len(before) == 1 and resume.pending(first, folder, name).count() == 0
    # again: nothing is transformed and nothing written
    files = sorted(str(p) for p in (tmp_path / "states" / "subjects").rglob("*.parquet"))
    same(by_key(update(first)), got)
    assert runs(spark, folder, "states") == before and sorted(str(p) for p in (tmp_path / "states" / "subjects").rglob("*.parquet")) == files
    # one more session: it alone is transformed, and only its subject's results are written anew
    full = by_key(update(signals))
    same(full, by_key(pipeline.analyze_subject(signals, events, montage, regions, config)))
    (new,) = runs(spark, folder, "states") - before
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/spectra/run={new}").select("subject", "session").distinct().collect()} == {("r1", "d1")}
    after = sorted(str(p) for p in (tmp_path / "states" / "subjects").rglob("*.parquet"))
    assert {f for f in files if "subject=r1" not in f} == {f for f in after if "subject=r1" not in f} and files != after
    sessions = resume.merged_sessions(resume.session_states(spark, folder, name), config)
    want = pipeline.analyze_session(signals, events, montage, regions, config)
    key = lambda df: {(r["subject"], r["session"], r["size"], r["f_idx"], r["k"]): (r["z"], r["n_events"], r["t"]) for r in df.collect()}
    same(key(sessions), key(want))


def test_lost_runs_and_failures(spark, data, tmp_path):
    signals, events, montage, regions = data
    folder, name = f"file://{tmp_path}/states", resume.analysis_id(CONFIG, REGIONS)
    bad = signals.withColumn("samples", F.when((F.col("subject") == "r0") & (F.col("channel_idx") == 0), F.array().cast("array<double>")).otherwise(F.col("samples")))
    resume.run_pending(bad, events, montage, regions, CONFIG, folder, name)
    # a run that was lost before its markers counts for nothing
    lost = spark.read.parquet(f"{folder}/states").drop("run").where("subject = 'r2'").withColumn("total", F.lit(1e9))
    lost.write.parquet(f"{folder}/states/run=99")
    states = resume.session_states(spark, folder, name)
    assert states.where("total > 1e8").count() == 0
    assert {(r["subject"], r["n_failed"]) for r in resume.markers(spark, folder, name).collect()} == {("r0", 1), ("r1", 0), ("r2", 0)}
    assert resume.pending(signals, folder, name).count() == 0 and resume.pending(signals, folder, name, retry=True).count() == 2
    # worked out again from whole traces, the last run counts
    resume.run_pending(signals, events, montage, regions, CONFIG, folder, name, retry=True)
    same(by_key(resume.merged_subjects(resume.session_states(spark, folder, name), CONFIG)), by_key(pipeline.analyze_subject(signals, events, montage, regions, CONFIG)))
    # sessions without events are done, with no cells; other settings share nothing
    quiet = signals.withColumn("subject", F.lit("quiet"))
    assert resume.run_pending(quiet, events, montage, regions, CONFIG, folder, name).count() == 2
    assert resume.pending(quiet, folder, name).count() == 0
    assert resume.pending(signals, folder, resume.analysis_id(CONFIG, {"front": [8]})).count() == 6
    assert resume.update_subjects(signals.where("subject = ''"), events, montage, regions, CONFIG, f"file://{tmp_path}/none", name).count() == 0


def test_command_line_resumes(spark, data, tmp_path):
    from epochlake.__main__ import run

    signals, events, *_ = data
    rec, states = f"file://{tmp_path}/rec", f"file://{tmp_path}/out-states"
    (tmp_path / "m.csv").write_text("rat_id,ch_0,ch_1,ch_2\n" + "".join(f"r{s},8,6,9\n" for s in range(3)))
    args = ["--data", rec, "--montage", f"file://{tmp_path}/m.csv", "--n-freqs", "2", "--window", "1.0", "--normalization", "channel_global", "--out", f"file://{tmp_path}/out", "--resume"]
    sinks.write_recordings(signals.where("NOT (subject = 'r2' AND session = 'd0')"), events, rec)
    run(spark, ["subject", *args])
    assert len(runs(spark, states, "states")) == 1
    run(spark, ["subject", *args, "--block", "1000"])
    assert len(runs(spark, states, "states")) == 1
    rows = spark.read.parquet(f"file://{tmp_path}/out").count()
    sinks.write_recordings(signals, events, rec)
    run(spark, ["subject", *args, "--block", "1000"])
    assert len(runs(spark, states, "states")) == 2 and spark.read.parquet(f"file://{tmp_path}/out").count() == rows
    assert {r["state"] for r in spark.read.json(f"file://{tmp_path}/out-progress").collect()} == {"completed"}
    run(spark, ["report", *args])
    assert spark.read.json(f"file://{tmp_path}/out").count() == 3
    run(spark, ["session", *args[:-3], "--out", f"file://{tmp_path}/out", "--resume"])
    assert spark.read.parquet(f"file://{tmp_path}/out").select("subject", "session").distinct().count() == 6
