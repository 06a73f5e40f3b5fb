"""Composite analyses: recordings to event-locked spectra of sessions, subjects and the population.

signals: (subject, session, channel_idx, fs, t0, samples array<double>), events: (subject, session, event_idx, kind, t,
size), montage: (subject, channel_idx, electrode).  Regions are many at once: what the analysis of each electrode in turn
would recompute is one query with the region as a key.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BANDS, AnalysisConfig, resolve_region
from ..functions.columns import axis_range, axis_time, bind, floored, time_slice
from ..operators import averages, blocks, catalog, normalize
from ..operators.blocks import needs_z, window_slice
from ..operators.montage import compatibility, session_montage
from ..operators.spectral import cycles, multitaper_psd, row_z, wavelet_rows, welch_psd
from ..sources import sinks


def region_table(spark: SparkSession, regions: dict[str, str | list[int]]) -> DataFrame:
    """(region, electrode) of named specifications."""
    return spark.createDataFrame([(name, e) for name, spec in regions.items() for e in resolve_region(spec)], "region string, electrode int")


def region_signals(signals: DataFrame, montage: DataFrame, regions: DataFrame, config: AnalysisConfig) -> DataFrame:
    """signals with the regions (array) their channel is in; other channels are left out before any transform.

    The channel list of all subjects is joined, not collected; a subject without a channel of a region is absent there.
    """
    wanted = montage.join(regions, "electrode").groupBy(F.col("subject").alias("montage_subject"), "channel_idx").agg(F.collect_set("region").alias("regions"))
    s = session_montage(signals.withColumnRenamed("session", "session_date"), config.montage_exceptions if config.session_montage == "per_session" else {})
    return s.join(wanted, ["montage_subject", "channel_idx"]).withColumnRenamed("session_date", "session").drop("montage_subject")


def event_spectra(signals: DataFrame, events: DataFrame, config: AnalysisConfig, kind: str = "nm") -> DataFrame:
    """(subject, session, regions, channel_idx, size, event_idx, f_idx, freq, w): Morlet power windows of every event.

    The events of a session travel with each of its channels, so a recording's spectrum stays inside its task, one frequency
    at a time, and only windows leave it; blocks.event_spectra spreads a recording over tasks.  Power is z-scored over the whole recording first unless baseline_input is "raw" (or there is
    no normalization).  Events whose window leaves the recording are dropped; windows are trimmed or edge-padded to
    config.samples.  A trace that fails is a row with error.
    """
    per = events.where(F.col("kind") == kind).groupBy("subject", "session").agg(F.sort_array(F.collect_list(F.struct("event_idx", F.col("t").alias("e"), "size"))).alias("ev"))
    joined = signals.join(per, ["subject", "session"]).select("subject", "session", "regions", "channel_idx", "fs", "t0", "samples", "ev")
    freqs = np.array(config.grid())
    n_cycles = cycles(freqs, config.cycles, config.cycles_fixed, config.cycles_factor, config.cycles_min)
    # without a sample in the baseline, events are normalized by the recording's statistics, which is its z
    zscored = needs_z(config)
    schema = T.StructType.fromDDL("subject string, session string, regions array<string>, channel_idx int, size double, event_idx int, f_idx int, freq double, w array<double>, error string")

    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.string()]
    n_freqs, n, step = len(freqs), config.samples, max(1, 512 // len(freqs))

    def table(key, events, w: np.ndarray) -> pa.RecordBatch:
        """Rows of some events, w [event, frequency, sample] as one buffer."""
        size = len(events) * n_freqs
        cols = [pa.array([k] * size, t) for k, t in zip(key, types[:4], strict=True)]
        cols += [pa.array(np.repeat([ev[c] for ev in events], n_freqs), t) for c, t in (("size", pa.float64()), ("event_idx", pa.int32()))]
        cols += [pa.array(np.tile(np.arange(n_freqs, dtype="i4"), len(events))), pa.array(np.tile(freqs, len(events)))]
        cols += [pa.ListArray.from_arrays(np.arange(size + 1, dtype="i4") * n, np.ascontiguousarray(w).ravel()), pa.nulls(size, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                key = (row["subject"].as_py(), row["session"].as_py(), row["regions"].as_py(), row["channel_idx"].as_py())
                try:
                    x = row["samples"].values.to_numpy(zero_copy_only=False).astype(float)
                    if not len(x):
                        raise ValueError("empty trace")
                    fs, times = row["fs"].as_py(), row["t0"].as_py() + np.arange(len(x)) / row["fs"].as_py()
                    cuts = [(ev, window_slice(times, ev["e"], config.half, n)) for ev in row["ev"].as_py()]
                    cuts = [(ev, cut) for ev, cut in cuts if cut is not None]
                    # one frequency at a time; only windows stay
                    w = np.empty((len(cuts), n_freqs, n))
                    for i, p in enumerate(wavelet_rows("morlet", x, freqs, fs, n_cycles)):
                        if zscored:
                            p = row_z(p[None, :])[0]
                        for j, (_, cut) in enumerate(cuts):
                            w[j, i] = p[cut]
                    out = [table(key, [ev for ev, _ in cuts[i : i + step]], w[i : i + step]) for i in range(0, len(cuts), step)]
                except Exception as e:  # noqa: BLE001  a bad trace is a row
                    values = (*key, None, None, None, None, None, f"{type(e).__name__}: {e}")
                    out = [pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=schema.names)]
                yield from out

    return joined.mapInArrow(run, schema)


def _mean_arrays(arrays: Column) -> Column:
    total = F.aggregate(F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0))), arrays[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.transform(total, lambda v: v / F.size(arrays))


def _no_baseline(config: AnalysisConfig) -> bool:
    return config.normalization == "baseline_per_event" and not axis_range(config.samples, config.half, *config.baseline)


def region_windows(spectra: DataFrame) -> DataFrame:
    """(region, subject, session, size, event_idx, f_idx, freq, w, n_channels): mean over the channels of each region."""
    keys = ["region", "subject", "session", "size", "event_idx", "f_idx", "freq"]
    ok = spectra.where("error IS NULL").withColumn("region", F.explode("regions"))
    return ok.groupBy(*keys).agg(_mean_arrays(F.collect_list("w")).alias("w"), F.count(F.lit(1)).alias("n_channels"))  # channels of a region are few


def baseline_report(spectra: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(region, subject, session, size, f_idx, freq, mu, sd, n_events, n_baseline_samples, warnings): what the cross-event
    baseline divides by."""
    keys = ["region", "subject", "session", "size", "f_idx", "freq"]
    return normalize.baseline_statistics(region_windows(spectra), keys, config.samples, config.half, config.baseline, config.min_events)


def session_windows(signals: DataFrame, events: DataFrame, montage: DataFrame, regions: DataFrame, config: AnalysisConfig, spectra: DataFrame | None = None) -> DataFrame:
    """(region, subject, session, size, event_idx, f_idx, freq, w, n_channels): region mean over channels, normalized.

    Channels whose trace failed are not in the mean; n_channels says how many are, failures(spectra) which are not.  spectra:
    event_spectra's rows, where the caller has written them."""
    if spectra is None:
        spectra = event_spectra(region_signals(signals, montage, regions, config), events, config)
    w = region_windows(spectra)
    if config.normalization == "baseline_cross_event":
        return normalize.baseline_cross_event(w, ["region", "subject", "session", "size", "f_idx"], config.samples, config.half, config.baseline)
    if config.normalization == "baseline_per_event" and not _no_baseline(config):
        return normalize.baseline_per_event(w, config.samples, config.half, config.baseline)
    return w


def processing_report(spectra: DataFrame) -> DataFrame:
    """Per subject and session: traces analysed, failed ones and success rate in percent."""
    runs = spectra.groupBy("subject", "session", "channel_idx").agg((F.count("error") == 0).alias("ok"))
    return catalog.failure_report(runs, ["subject", "session"])


def eligible(signals: DataFrame, montage: DataFrame, regions: DataFrame) -> DataFrame:
    """signals of the subjects that have every electrode of all regions; others lack or mismatch a region."""
    bad = compatibility(montage, regions).where("NOT compatible").select(F.col("subject").alias("bad")).distinct()
    known = montage.select(F.col("subject").alias("known")).distinct()
    return signals.join(known, F.col("subject") == F.col("known"), "left_semi").join(bad, F.col("subject") == F.col("bad"), "left_anti")


def analyze_session(signals, events, montage, regions, config: AnalysisConfig, spectra: DataFrame | None = None) -> DataFrame:
    """(region, subject, session, size, f_idx, freq, k, t, z, n_events, n_channels): mean over the events of each session."""
    return _spectrogram(session_windows(signals, events, montage, regions, config, spectra), ["region", "subject", "session", "size"], config)


def _spectrogram(windows: DataFrame, keys: list[str], config: AnalysisConfig) -> DataFrame:
    cells = averages.cell_sums(windows, [*keys, "f_idx", "freq"])
    return cells.select(*keys, "f_idx", "freq", "k", (F.col("total") / F.col("n_events")).alias("z"), "n_events", "n_channels", axis_time(F.col("k"), config.samples, config.half).alias("t"))


def analyze_subject(signals, events, montage, regions, config: AnalysisConfig, spectra: DataFrame | None = None) -> DataFrame:
    """(region, subject, size, f_idx, freq, k, t, z, n_events, n_sessions, n_channels (the least)), weighted by events or by sessions."""
    keys = ["region", "subject", "size", "f_idx", "freq", "k"]
    s = analyze_session(signals, events, montage, regions, config, spectra)
    weight = F.col("n_events") if config.session_weighting == "event" else F.lit(1)
    out = s.groupBy(*keys).agg((F.sum(F.col("z") * weight) / F.sum(weight)).alias("z"), F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_sessions"), F.min("n_channels").alias("n_channels"))
    return out.withColumn("t", axis_time(F.col("k"), config.samples, config.half))


def analyze_population(subjects: DataFrame) -> DataFrame:
    """Unweighted mean over subjects of analyze_subject's rows, with totals."""
    return averages.population_mean(subjects, ["region", "size", "f_idx", "freq", "k", "t"], "z").withColumnRenamed("mean", "z")


def analyze_all_channels(spark: SparkSession, signals, events, montage, config: AnalysisConfig, electrodes: range = range(1, 33)) -> DataFrame:
    """analyze_subject with each electrode as a region of its own, in one query."""
    return analyze_subject(signals, events, montage, region_table(spark, {str(e): [e] for e in electrodes}), config)


def theta_power(spectrogram: DataFrame, keys: list[str], config: AnalysisConfig) -> DataFrame:
    """Mean over the theta band and the response window; a band without frequencies is an error."""
    freqs = np.array(config.grid())
    if not ((freqs >= config.theta[0]) & (freqs <= config.theta[1])).any():
        raise ValueError(f"no frequency in {config.theta}")
    ks = axis_range(config.samples, config.half, *config.response)
    cells = spectrogram.where(F.col("freq").between(*config.theta) & F.col("k").between(ks[0], ks[-1]))
    return cells.groupBy(*keys).agg(F.avg("z").alias("power"))


def theta_report(subjects: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(region, size, mean, se, n) of theta power over subjects."""
    return averages.mean_and_error(theta_power(subjects, ["region", "subject", "size"], config), ["region", "size"], "power")


def velocity_at_events(velocity: DataFrame, events: DataFrame) -> DataFrame:
    """Speed trace (subject, session, t, v) sampled nearest each event."""
    from ..operators.epochs import nearest_sample

    return nearest_sample(events.withColumnRenamed("t", "e"), velocity, ["subject", "session"])


def recording_statistics(signals: DataFrame) -> DataFrame:
    """Per channel: mean, population spread, extremes and duration, from the arrays alone."""
    x = F.col("samples")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    spread = floored(F.sqrt(bind(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))) / F.size(x)))
    return signals.select("subject", "session", "channel_idx", mean.alias("mean"), spread.alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), (F.size(x) / F.col("fs")).alias("duration"))


def analyze_channels(traces: DataFrame, keys: list[str], fs: float, time_range: tuple[float, float] | None = None, bands: dict[str, tuple[float, float]] = BANDS, size: int = 1024, method: str = "welch") -> DataFrame:
    """Per trace (keys, w): descriptive statistics, band powers and the peak frequency of its power density."""
    t = traces.select(*keys, time_slice(F.col("w"), fs, *time_range, required=True).alias("w") if time_range else F.col("w"))
    x = F.col("w")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    spread = F.sqrt(bind(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))) / F.size(x))
    stats = t.select(*keys, mean.alias("mean"), spread.alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), (F.size(x) / F.lit(fs)).alias("duration"))
    psd = welch_psd(t, keys, fs, size) if method == "welch" else multitaper_psd(t, keys, fs)
    power = [averages.trapezoid(psd, keys, *b).alias(name) for name, b in bands.items()]
    found = psd.groupBy(*keys).agg(*power, averages.peak(1.0, 45.0).alias("m")).select(*keys, *bands, (-F.col("m.col2")).alias("peak_freq"), F.col("m.p").alias("peak_power"))
    return stats.join(found, keys)


def diagnostic_cells(signals: DataFrame, events: DataFrame, config: AnalysisConfig, block: int = blocks.BLOCK) -> DataFrame:
    """(subject, session, channel_idx, size, event_idx, f_idx, freq, raw, z, mu, sd), written: each sample of the event windows as
    power and as z over its whole recording, with what the z is against."""
    raw = blocks.event_spectra(signals, events, replace(config, normalization="none"), size=block).where("error IS NULL")
    stats = blocks.spectral_moments(signals, config, size=block).where("error IS NULL")
    stats = stats.select(*blocks.CHANNEL, F.posexplode(F.arrays_zip("mu", "sd")).alias("f_idx", "x")).select(*blocks.CHANNEL, "f_idx", "x.mu", "x.sd")
    cells = raw.select(*blocks.CHANNEL, "size", "event_idx", "f_idx", "freq", F.explode("w").alias("raw")).join(stats, [*blocks.CHANNEL, "f_idx"])
    return sinks.staged(cells.withColumn("z", (F.col("raw") - F.col("mu")) / F.col("sd")), "diagnostics")


def diagnostics_by_frequency(cells: DataFrame, keys: list[str] = blocks.CHANNEL) -> DataFrame:
    """(keys, f_idx, freq, mu, sd, ratio, raw_mean, raw_std, z_mean, z_std): the recording's mean and spread beside those of the
    event windows, as power and as z; spreads are population ones."""
    one = lambda c: [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    out = cells.groupBy(*keys, "f_idx", "freq").agg(F.first("mu").alias("mu"), F.first("sd").alias("sd"), *one("raw"), *one("z"))
    return out.select(*keys, "f_idx", "freq", "mu", "sd", (F.col("mu") / F.col("sd")).alias("ratio"), "raw_mean", "raw_std", "z_mean", "z_std")


def diagnostics_by_size(cells: DataFrame, keys: list[str] = blocks.CHANNEL) -> DataFrame:
    """(keys, size, measure, min, max, mean, std, p25, p50, p75, n_events) of all samples of the windows of each size, measure raw
    or z; percentiles are exact."""
    long = cells.select(*keys, "size", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("raw", "z")])).alias("x")).select(*keys, "size", "x.measure", "x.v")
    n = cells.groupBy(*keys, "size").agg(F.count_distinct("event_idx").alias("n_events"))
    return averages.percentiles(long, [*keys, "size", "measure"], "v").join(n, [*keys, "size"])


def session_texts(sessions: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(subject, session, value): of each session of analyze_session's rows a short text of `key: value` lines."""
    first = sessions.groupBy("subject", "session", "region", "size").agg(F.max("n_events").alias("n"), F.min("freq").alias("lo"), F.max("freq").alias("hi"), F.max("n_channels").alias("channels"))
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    sizes = F.sort_array(F.collect_list(F.struct("size", "n")))
    one = first.groupBy("subject", "session", "region").agg(sizes.alias("s"), F.sum("n").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("channels").alias("channels"))
    lines = [
        F.concat(F.lit("region: "), "region"),
        F.concat(F.lit("channels: "), "channels"),
        F.concat(F.lit("frequency_range: "), F.format_string("%.1f-%.1f Hz", "lo", "hi")),
        F.concat(F.lit("normalization: "), F.lit(config.normalization)),
        F.concat(F.lit("nm_sizes_analyzed: "), F.array_join(F.transform("s", lambda x: number(x["size"])), ", ")),
        F.concat(F.lit("events_per_size: "), F.array_join(F.transform("s", lambda x: F.concat(number(x["size"]), F.lit("="), x["n"])), ", ")),
        F.concat(F.lit("total_events_analyzed: "), "total"),
    ]
    text = one.select("subject", "session", "region", F.concat_ws("\n", *lines).alias("part"))
    head = F.concat(F.lit("session: "), "subject", F.lit("_"), "session", F.lit("\n"))
    return text.groupBy("subject", "session").agg(F.sort_array(F.collect_list(F.struct("region", "part"))).alias("p")).select("subject", "session", F.concat(head, F.array_join(F.transform("p", lambda x: x["part"]), "\n")).alias("value"))
