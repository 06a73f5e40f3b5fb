"""Command line: python -m epochlake {import,session,subject,population,channels,report,summary} --data DIR --out DIR ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .config import CYCLES, NORMALIZATIONS, AnalysisConfig
from .operators import blocks, catalog, spectral
from .plans import pipeline, resume
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="epochlake", description="Event-locked spectra of recordings.")
    p.add_argument("mode", choices=["import", "session", "subject", "population", "channels", "report", "summary"])
    p.add_argument("--data", required=True, help="folder with signals/ and events/ written by sinks.write_recordings; with import, the session files")
    p.add_argument("--montage", help="wide CSV of electrodes by channel")
    p.add_argument("--region", default="frontal", help='name, "8" or "8,16"')
    p.add_argument("--subject", help="one subject only")
    p.add_argument("--out", required=True)
    p.add_argument("--freq-min", type=float, default=AnalysisConfig.freq_min)
    p.add_argument("--freq-max", type=float, default=AnalysisConfig.freq_max)
    p.add_argument("--n-freqs", type=int, default=AnalysisConfig.n_freqs)
    p.add_argument("--freq-file", help="text list; its numbers within the range set the count and ends of the grid")
    p.add_argument("--every-second", action="store_true", help="take every second number of the list, from the greatest on")
    p.add_argument("--exact-freqs", action="store_true", help="analyse the list's own frequencies instead of a grid")
    p.add_argument("--eligible-only", action="store_true", help="leave out subjects that lack an electrode of the region")
    p.add_argument("--window", type=float, default=AnalysisConfig.window)
    p.add_argument("--fs", type=float, default=AnalysisConfig.fs)
    p.add_argument("--cycles", choices=CYCLES, default=AnalysisConfig.cycles)
    p.add_argument("--normalization", choices=NORMALIZATIONS, default=AnalysisConfig.normalization)
    p.add_argument("--block", type=int, help="samples of a block: recordings are transformed in blocks spread over tasks, not as wholes")
    p.add_argument("--resume", action="store_true", help="keep states of sessions in OUT-states: a later run works out only what is not in there")
    p.add_argument("--retry-failed", action="store_true", help="with --resume, also sessions with failed traces")
    p.add_argument("--weighting", choices=["event", "session"], default=AnalysisConfig.session_weighting)
    return p


def settings(spark: SparkSession, a: argparse.Namespace) -> AnalysisConfig:
    """A frequency list contributes its extended range and count; the grid itself is geometric."""
    lo, hi, n, exact = a.freq_min, a.freq_max, a.n_freqs, ()
    if a.freq_file:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        from .functions.columns import select_frequencies

        listed = readers.frequency_text(spark, a.freq_file)
        if a.every_second:  # a list of frequencies is short
            listed = readers.every_second(listed.withColumn("f_idx", F.row_number().over(Window.orderBy(F.desc("freq"))) - 1))
        chosen = select_frequencies(listed, lo, hi, extended=True)
        lo, hi, n = chosen.agg(F.min("freq"), F.max("freq"), F.count("freq")).first()
        if a.exact_freqs:
            exact = tuple(r["freq"] for r in chosen.collect())
    return AnalysisConfig(fs=a.fs, freq_min=lo, freq_max=hi, n_freqs=n, window=a.window, cycles=a.cycles, normalization=a.normalization, session_weighting=a.weighting, freqs=exact)


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.mode == "import":
        signals, events, velocity, failures = readers.mat_recordings(readers.mat_sessions(spark, a.data), a.fs)
        sinks.write_recordings(signals, events, a.out)
        velocity.write.mode("overwrite").partitionBy("subject").parquet(f"{a.out}/velocity")
        sinks.write_json(failures, f"{a.out}-failures")
        return
    signals, events = readers.recordings(spark, a.data)
    if a.subject:
        signals, events = readers.sessions_of(signals, a.subject), events.where(events.subject == a.subject)
    if a.mode == "summary":
        catalog.recording_sessions(signals, events).write.mode("overwrite").parquet(a.out)
        return
    if not a.montage:
        raise SystemExit("--montage is needed")
    config, montage = settings(spark, a), readers.montage_csv(spark, a.montage)
    names = {str(e): [e] for e in range(1, 33)} if a.mode == "channels" else {a.region: a.region}
    regions = pipeline.region_table(spark, names)
    if a.eligible_only:
        signals = pipeline.eligible(signals, montage, regions)
    if a.resume:
        _resumed(spark, a, names, signals, events, montage, regions, config)
        return
    # spectra are written once: results, failures and the report of traces are all taken from them
    ready = pipeline.region_signals(signals, montage, regions, config)
    found = blocks.event_spectra(ready, events, config, size=a.block) if a.block else pipeline.event_spectra(ready, events, config)
    found.write.mode("overwrite").parquet(f"{a.out}-spectra")
    spectra = spark.read.parquet(f"{a.out}-spectra")
    sinks.write_json(spectral.failures(spectra, ["subject", "session", "channel_idx"]), f"{a.out}-failures")
    sinks.write_run_summary(pipeline.processing_report(spectra), config.summary(), f"{a.out}-summary")
    if config.normalization == "baseline_cross_event":
        sinks.write_json(pipeline.baseline_report(spectra, config), f"{a.out}-baseline")
    if a.mode == "session":
        pipeline.analyze_session(signals, events, montage, regions, config, spectra).write.mode("overwrite").parquet(a.out)
        sinks.write_texts(pipeline.session_texts(spark.read.parquet(a.out), config), f"{a.out}-texts")
    else:
        _write_subjects(a, pipeline.analyze_subject(signals, events, montage, regions, config, spectra), config)


def _write_subjects(a: argparse.Namespace, out: DataFrame, config: AnalysisConfig) -> None:
    if a.mode == "report":
        sinks.write_json(pipeline.theta_report(out, config), a.out)
        sinks.write_json(pipeline.theta_power(out, ["region", "subject", "size"], config), f"{a.out}-subjects")
        return
    if a.mode == "population":
        out = pipeline.analyze_population(out)
    out.write.mode("overwrite").parquet(a.out)


def _resumed(spark: SparkSession, a: argparse.Namespace, names: dict, signals: DataFrame, events: DataFrame, montage: DataFrame, regions: DataFrame, config: AnalysisConfig) -> None:
    folder, analysis = f"{a.out}-states", resume.analysis_id(config, names)
    subjects = resume.update_subjects(signals, events, montage, regions, config, folder, analysis, a.retry_failed, a.block)
    sinks.write_json(resume.markers(spark, folder, analysis).where("n_failed > 0"), f"{a.out}-failures")
    sinks.write_json(catalog.progress(signals, resume.markers(spark, folder, analysis), "subject", "session"), f"{a.out}-progress")
    if a.mode == "session":
        resume.merged_sessions(resume.session_states(spark, folder, analysis), config).write.mode("overwrite").parquet(a.out)
        sinks.write_texts(pipeline.session_texts(spark.read.parquet(a.out), config), f"{a.out}-texts")
    else:
        _write_subjects(a, subjects, config)


if __name__ == "__main__":
    run(SparkSession.builder.appName("epochlake").getOrCreate())
