"""Analyses that go on where they stopped: states of sessions that can be added up, and markers of what is done.

Below a folder, states/run=R holds what run R worked out: for each session and cell the sum of its windows and how many
there are; done/run=R holds the sessions of that run, written after their states.  A run that is lost leaves no markers, so
its states count for nothing and its sessions are still pending.  Runs of one folder follow each other.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.columns import axis_time
from ..operators import averages, blocks
from ..sources import sinks
from . import pipeline

CELL = ["region", "subject", "session", "size", "f_idx", "freq", "k"]
STATE = "analysis string, region string, subject string, session string, size double, f_idx int, freq double, k int, total double, n_events long, n_channels long"
DONE = "analysis string, subject string, session string, n_traces long, n_failed long"


def analysis_id(config: AnalysisConfig, regions: dict[str, str | list[int]]) -> str:
    """States of other settings or regions are never added together."""
    settings = json.dumps([config.summary(), regions], sort_keys=True, default=str)
    return hashlib.sha256(settings.encode()).hexdigest()[:16]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, run long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{schema}, run long")
        raise


def markers(spark: SparkSession, folder: str, analysis: str) -> DataFrame:
    """(subject, session, run, n_traces, n_failed): the last run that finished each session."""
    last = F.max(F.struct("run", "n_traces", "n_failed")).alias("m")
    return _stored(spark, f"{folder}/done", DONE).where(F.col("analysis") == analysis).groupBy("subject", "session").agg(last).select("subject", "session", "m.*")


def pending(signals: DataFrame, folder: str, analysis: str, retry: bool = False) -> DataFrame:
    """(subject, session) of signals that no run has finished; with retry, also those with failed traces."""
    done = markers(signals.sparkSession, folder, analysis)
    if retry:
        done = done.where("n_failed = 0")
    return signals.select("subject", "session").distinct().join(done, ["subject", "session"], "left_anti")


def run_pending(signals: DataFrame, events: DataFrame, montage: DataFrame, regions: DataFrame, config: AnalysisConfig, folder: str, analysis: str, retry: bool = False, block: int | None = None) -> DataFrame:
    """(subject, session, n_traces, n_failed) of the sessions that this run worked out; no other session is transformed.

    A session whose recording has no event, or no channel of the regions, is done with no cells."""
    spark, run = signals.sparkSession, time.time_ns()
    sessions = pending(signals, folder, analysis, retry)
    todo = f"{folder}/todo/run={run}"
    sessions.write.parquet(todo)  # what is pending is settled before anything is added
    sessions = spark.read.schema("subject string, session string").parquet(todo)
    if sessions.isEmpty():
        return spark.createDataFrame([], "subject string, session string, n_traces long, n_failed long")
    own = signals.join(sessions, ["subject", "session"], "left_semi")
    ready = pipeline.region_signals(own, montage, regions, config)
    spectra = blocks.event_spectra(ready, events, config, size=block) if block else pipeline.event_spectra(ready, events, config)
    spectra.write.parquet(f"{folder}/spectra/run={run}")
    spectra = spark.read.schema(spectra.schema).parquet(f"{folder}/spectra/run={run}")
    windows = pipeline.session_windows(own, events, montage, regions, config, spectra)
    states = averages.cell_sums(windows, CELL[:-1])
    states.select(F.lit(analysis).alias("analysis"), *CELL, "total", "n_events", "n_channels").write.parquet(f"{folder}/states/run={run}")
    report = pipeline.processing_report(spectra).select("subject", "session", F.col("n").alias("n_traces"), "n_failed")
    done = sessions.join(report, ["subject", "session"], "left").fillna(0, ["n_traces", "n_failed"])
    done.select(F.lit(analysis).alias("analysis"), "subject", "session", "n_traces", "n_failed").write.parquet(f"{folder}/done/run={run}")
    return _stored(spark, f"{folder}/done", DONE).where(F.col("run") == run).select("subject", "session", "n_traces", "n_failed")


def session_states(spark: SparkSession, folder: str, analysis: str, subjects: DataFrame | None = None) -> DataFrame:
    """States of finished sessions, each from its last run; of some subjects only, if given."""
    done = markers(spark, folder, analysis).select("subject", "session", "run")
    if subjects is not None:
        done = done.join(subjects.select("subject").distinct(), "subject", "left_semi")
    return _stored(spark, f"{folder}/states", STATE).where(F.col("analysis") == analysis).join(done, ["subject", "session", "run"], "left_semi")


def merged_sessions(states: DataFrame, config: AnalysisConfig) -> DataFrame:
    """States as the rows of pipeline.analyze_session."""
    mean = (F.col("total") / F.col("n_events")).alias("z")
    return states.select(*CELL, mean, "n_events", "n_channels", axis_time(F.col("k"), config.samples, config.half).alias("t"))


def merged_subjects(states: DataFrame, config: AnalysisConfig) -> DataFrame:
    """States added up to the rows of pipeline.analyze_subject."""
    keys = [c for c in CELL if c != "session"]
    mean = F.sum("total") / F.sum("n_events") if config.session_weighting == "event" else F.avg(F.col("total") / F.col("n_events"))
    out = states.groupBy(*keys).agg(mean.alias("z"), F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_sessions"), F.min("n_channels").alias("n_channels"))
    return out.withColumn("t", axis_time(F.col("k"), config.samples, config.half))


def update_subjects(signals: DataFrame, events: DataFrame, montage: DataFrame, regions: DataFrame, config: AnalysisConfig, folder: str, analysis: str, retry: bool = False, block: int | None = None) -> DataFrame:
    """Work out what is pending and write the results of the subjects it touches below folder/subjects (one partition each,
    others are left as they are); every subject's results, read from there."""
    spark = signals.sparkSession
    new = run_pending(signals, events, montage, regions, config, folder, analysis, retry, block)
    path = f"{folder}/subjects/{analysis}"
    if not new.isEmpty():
        sinks.write_results(merged_subjects(session_states(spark, folder, analysis, new), config), path, ["subject"])
    schema = "region string, size double, f_idx int, freq double, k int, z double, n_events long, n_sessions long, n_channels long, t double, subject string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
