"""Recordings as blocks of samples: windows joined to the blocks they touch, and spectra of blocks with halos.

Pieces are rows (subject, session, channel_idx, fs, t0, start, samples array<double>): any run of a recording's samples from
its sample number `start` on, a whole recording as one piece or many.  No task needs more than one block of a recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AnalysisConfig, memory_estimate
from ..functions.columns import floored
from .spectral import cycles, morlet

CHANNEL = ["subject", "session", "channel_idx"]
#: Samples of a block, and the fewest that a block is cut into when memory is short.
BLOCK, LEAST_BLOCK = 30_000, 64
#: Bytes that the transform of a block may take (see config.memory_estimate).
BUDGET = 256 << 20
#: Events whose windows a task holds at a time.
EVENTS_AT_ONCE = 32


def pieces(signals: DataFrame) -> DataFrame:
    """Whole recordings (channels as rows) as pieces; what has `start` already is left as it is."""
    return signals if "start" in signals.columns else signals.withColumn("start", F.lit(0).cast("long"))


def cut_blocks(signals: DataFrame, size: int, before: int = 0, after: int = 0, keys: list[str] = CHANNEL, carry: list[str] = ["fs", "t0"]) -> DataFrame:  # noqa: B006
    """(keys, carry, block, first, gap, w): block number b holds the samples from b * size on, and up to `before` of the
    samples in front and `after` behind, of which w[0] is number first; gap tells whether samples are missing in between.

    A piece sends each block the run of its samples that the block or its halo takes, so what moves is the signal itself
    and the halos.
    """
    p = pieces(signals)
    end = F.col("start") + F.size("samples")
    low = F.greatest(F.floor((F.col("start") - after) / size), F.lit(0)).cast("long")
    high = F.floor((end - 1 + before) / size).cast("long")
    touched = p.where(F.size("samples") > 0).select(*keys, *carry, "start", "samples", F.explode(F.sequence(low, high)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * size - before)
    hi = F.least(F.col("start") + F.size("samples"), (F.col("block") + 1) * size + after)
    runs = touched.select(*keys, *carry, "block", F.struct(lo.alias("start"), F.slice("samples", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("w")).alias("run"), hi.alias("end")).where("end > run.start")
    own = runs.groupBy(*keys, "block").agg(*[F.first(c).alias(c) for c in carry], F.sort_array(F.collect_list("run")).alias("runs"), F.max("end").alias("end"))
    own = own.select(*keys, *carry, "block", F.col("runs")[0]["start"].alias("first"), "end", F.flatten(F.transform("runs", lambda r: r["w"])).alias("w"))
    # a block past the recording's end has nothing but a halo
    return own.where(F.col("end") > F.col("block") * size).select(*keys, *carry, "block", "first", (F.col("end") - F.col("first") != F.size("w")).alias("gap"), "w")


# -- windows on stored blocks --------------------------------------------------


def time_blocks(samples: DataFrame, keys: list[str], width: int | float) -> DataFrame:
    """(keys, block, s): samples (keys, t, v) by stretches of time of `width`, each an array of (t, v) in order: how a
    recording is stored so that a later join moves blocks, not samples."""
    block = F.floor(F.col("t") / F.lit(width)).cast("long").alias("block")
    return samples.groupBy(*keys, block).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))


def block_windows(events: DataFrame, blocks: DataFrame, half: int | float, keys: list[str], width: int | float, whole: bool = True) -> DataFrame:
    """(events' columns, s): the samples (t, v) with t in [e - half, e + half) of each event, in order, from time_blocks of
    the same width; with whole, only events whose window lies within their recording's first and last sample.  Rows as
    event_windows gives them, exploded; an event without a sample is absent.

    An event goes to the blocks its window touches (one or two if width >= 2 * half); each block sends the slice it has,
    and the slices are stitched.
    """
    b = lambda x: F.floor(x / F.lit(width)).cast("long")
    cols = [c for c in events.columns if c not in keys]
    e = events
    if whole:
        ends = blocks.groupBy(*keys).agg(F.min(F.col("s")[0]["t"]).alias("t_first"), F.max(F.element_at("s", -1)["t"]).alias("t_last"))
        e = e.join(ends, keys).where((F.col("e") - half >= F.col("t_first")) & (F.col("e") + half <= F.col("t_last"))).drop("t_first", "t_last")
    e = e.withColumn("block", F.explode(F.sequence(b(F.col("e") - half), b(F.col("e") + half))))
    inside = F.filter("s", lambda x: (x["t"] >= F.col("e") - half) & (x["t"] < F.col("e") + half))
    found = e.join(blocks, [*keys, "block"]).select(*events.columns, "block", inside.alias("s")).where(F.size("s") > 0)
    slices = F.sort_array(F.collect_list(F.struct("block", "s")))
    return found.groupBy(*keys, *cols).agg(F.flatten(F.transform(slices, lambda x: x["s"])).alias("s"))


# -- spectra -------------------------------------------------------------------


def fast_size(n: int) -> int:
    """The least product of powers of 2, 3 and 5 from n on."""
    best = 1 << max(n - 1, 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(-(-n // three) - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


class Wavelets:
    """Morlet wavelets of a grid, with the reach of the longest on each side of a sample."""

    def __init__(self, freqs: np.ndarray, fs: float, n_cycles: np.ndarray):
        self.kernels = [morlet(f, fs, c) for f, c in zip(freqs, n_cycles, strict=True)]
        self.after = max((len(k) - 1) // 2 for k in self.kernels)
        self.before = max(len(k) - 1 - (len(k) - 1) // 2 for k in self.kernels)

    def power(self, w: np.ndarray, lo: int, hi: int, budget: float = BUDGET) -> Iterator[np.ndarray]:
        """|w * W|**2 at the positions [lo, hi) of w, one frequency after the other; w counts as zero outside.

        Overlap-save: one transform of the span and its halo for all frequencies; what wraps around falls on the halo.
        MemoryError, before anything is made, where that would take more than budget bytes."""
        size = fast_size(hi - lo + self.before + self.after)
        if memory_estimate(1, size) > budget:
            raise MemoryError(f"{memory_estimate(1, size):.0f} bytes for {hi - lo} samples")
        x = np.zeros(size)
        a, b = max(lo - self.before, 0), min(hi + self.after, len(w))
        x[a - lo + self.before : b - lo + self.before] = w[a:b]
        fx = np.fft.fft(x)
        for k in self.kernels:
            at = self.before + (len(k) - 1) // 2
            c = np.fft.ifft(fx * np.fft.fft(k, size))[at : at + hi - lo]
            yield c.real**2 + c.imag**2


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, M2) of two samples together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def moments(bank: Wavelets, w: np.ndarray, lo: int, hi: int, budget: float, attempts: int = 1) -> tuple[int, tuple, int]:
    """(samples, (mean, M2) arrays by frequency, attempts) of the power at [lo, hi): halves, merged, where memory is short."""
    try:
        found = [(p.mean(), ((p - p.mean()) ** 2).sum()) for p in bank.power(w, lo, hi, budget)]
        return hi - lo, (np.array([m for m, _ in found]), np.array([s for _, s in found])), attempts
    except MemoryError:
        if hi - lo < 2 * LEAST_BLOCK:
            raise
        mid = (lo + hi) // 2
        n1, a, k1 = moments(bank, w, lo, mid, budget, attempts + 1)
        n2, b, k2 = moments(bank, w, mid, hi, budget, attempts + 1)
        n, mean, m2 = _merged((n1, *a), (n2, *b))
        return n, (mean, m2), max(k1, k2)


def block_moments(blocks: DataFrame, size: int, config: AnalysisConfig, budget: float = BUDGET) -> DataFrame:
    """(subject, session, channel_idx, block, n, mean, m2, attempts, error): moments of each frequency's power over the
    samples of each block (from cut_blocks with the wavelets' reach as halo); attempts: how often it was halved, plus one."""
    freqs = np.array(config.grid())
    n_cycles = cycles(freqs, config.cycles, config.cycles_fixed, config.cycles_factor, config.cycles_min)
    doubles = pa.list_(pa.float64())

    def run(batches):
        banks: dict[float, Wavelets] = {}
        for b in batches:
            for i in range(b.num_rows):
                fs, block, first = (b.column(c)[i].as_py() for c in ("fs", "block", "first"))
                n, mean, m2, attempts, error = 0, None, None, None, None
                try:
                    w = b.column("w")[i].values.to_numpy(zero_copy_only=False).astype(float)
                    lo = block * size - first
                    if b.column("gap")[i].as_py() or lo < 0:
                        raise ValueError("samples are missing or repeated")
                    bank = banks.get(fs) or banks.setdefault(fs, Wavelets(freqs, fs, n_cycles))
                    n, (mean, m2), attempts = moments(bank, w, lo, min(lo + size, len(w)), budget)
                except Exception as e:  # noqa: BLE001  a bad block is a row
                    error = f"{type(e).__name__}: {e}"
                own = [b.column(c).slice(i, 1) for c in [*CHANNEL, "block"]]
                found = [pa.array([n], pa.int64()), pa.array([mean], doubles), pa.array([m2], doubles), pa.array([attempts], pa.int32()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *found], names=[*CHANNEL, "block", "n", "mean", "m2", "attempts", "error"])

    return blocks.mapInArrow(run, _schema(blocks, [*CHANNEL, "block"], "n long, mean array<double>, m2 array<double>, attempts int, error string"))


def _schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(more)])


def recording_moments(blocks: DataFrame, size: int, keys: list[str] = CHANNEL) -> DataFrame:
    """(keys, n, mu, sd, attempts, error) of block_moments: mean and floored population spread by frequency (arrays) over the
    whole recording; error also where blocks in between are missing.  Blocks are merged pairwise by the parallel formula, frequency by frequency, so nearly constant power
    loses no digits."""
    each = blocks.where("error IS NULL").select(*keys, "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("f_idx", "x"))
    run = F.aggregate(
        F.sort_array(F.collect_list(F.struct("x.mean", "n", "x.m2"))),
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["mean"] + (b["mean"] - a["mean"]) * b["n"] / (a["n"] + b["n"])).alias("mean"), (a["m2"] + b["m2"] + (b["mean"] - a["mean"]) * (b["mean"] - a["mean"]) * a["n"] * b["n"] / (a["n"] + b["n"])).alias("m2")),
    )
    one = each.groupBy(*keys, "f_idx").agg(run.alias("m"))
    arrays = one.groupBy(*keys).agg(F.max("m.n").cast("long").alias("n"), F.sort_array(F.collect_list(F.struct("f_idx", F.col("m.mean").alias("mu"), floored(F.sqrt(F.col("m.m2") / F.col("m.n"))).alias("sd")))).alias("x"))
    end = F.max(F.col("block") * size + F.col("n"))
    missing = F.when(F.sum("n") < end, "ValueError: blocks are missing")
    state = blocks.groupBy(*keys).agg(F.max("attempts").alias("attempts"), F.coalesce(F.min("error"), missing).alias("error"))
    return state.join(arrays, keys, "left").select(*keys, "n", F.col("x.mu").alias("mu"), F.col("x.sd").alias("sd"), "attempts", "error")


def _event_block(e: Column, half: float, size: int) -> Column:
    """Number of the block that holds the first sample of an event's window, give or take a sample."""
    return F.greatest(F.floor((e - half - F.col("t0")) * F.col("fs") / size), F.lit(0)).cast("long")


def event_spectra(signals: DataFrame, events: DataFrame, config: AnalysisConfig, kind: str = "nm", size: int = BLOCK, budget: float = BUDGET, carry: list[str] = ["regions"]) -> DataFrame:  # noqa: B006
    """(subject, session, carry, channel_idx, size, event_idx, f_idx, freq, w, error, attempts): the rows of
    pipeline.event_spectra, from blocks of a recording instead of the whole of it.

    First pass: each block's power, one frequency at a time, gives moments, which are merged over the recording.  Second
    pass: blocks with events get their events and the recording's moments, and cut the windows; a block's halo holds the
    wavelets' reach and, behind it, a window.  So z is over the whole recording, while tasks hold one block and the windows
    of EVENTS_AT_ONCE events.  Where a transform would exceed budget bytes, or memory runs out, the block is halved;
    attempts says how often, plus one.  A recording with missing samples, or a block too small to be halved, is a row with
    error; events whose window leaves the recording are dropped.
    """
    freqs = np.array(config.grid())
    n_cycles = cycles(freqs, config.cycles, config.cycles_fixed, config.cycles_factor, config.cycles_min)
    zscored = needs_z(config)
    n, step = config.samples, EVENTS_AT_ONCE
    rates = [r["fs"] for r in signals.select("fs").distinct().collect()]  # few sampling rates
    reach = [Wavelets(freqs, fs, n_cycles) for fs in rates] or [Wavelets(freqs, config.fs, n_cycles)]
    before, after = max(r.before for r in reach) + 2, max(r.after for r in reach) + 2
    window = max([int(np.ceil(2 * config.half * fs)) for fs in rates], default=n)
    blocks = cut_blocks(signals, size, before, after + window, carry=["fs", "t0", *carry])
    stats = recording_moments(block_moments(blocks, size, config, budget), size)
    starts = signals.select(*CHANNEL, "fs", "t0").distinct()
    wanted = events.where(F.col("kind") == kind).withColumnRenamed("size", "event_size").join(starts, ["subject", "session"])
    per = wanted.groupBy(*CHANNEL, _event_block(F.col("t"), config.half, size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("event_idx", F.col("t").alias("e"), F.col("event_size").alias("size")))).alias("ev"))
    ready = blocks.join(per, [*CHANNEL, "block"]).join(stats.where("error IS NULL").select(*CHANNEL, "n", "mu", "sd", "attempts"), CHANNEL)
    types = T.StructType([*[signals.schema[c] for c in ("subject", "session", *carry, "channel_idx")], *T.StructType.fromDDL("size double, event_idx int, f_idx int, freq double, w array<double>, error string, attempts int")])
    own = [f.name for f in types][: 3 + len(carry)]

    def windows(b: pa.RecordBatch, i: int, bank: Wavelets, w: np.ndarray, cuts: list, attempts: int) -> Iterator[pa.RecordBatch]:
        """Windows of some events, [event, frequency, sample] as one buffer."""
        lo, hi = int(min(c.min() for _, c in cuts)), int(max(c.max() for _, c in cuts)) + 1
        try:
            out = np.empty((len(cuts), len(freqs), n))
            mu, sd = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("mu", "sd"))
            for f, p in enumerate(bank.power(w, lo, hi, budget)):
                if zscored:
                    p = (p - mu[f]) / sd[f]
                for j, (_, cut) in enumerate(cuts):
                    out[j, f] = p[cut - lo]
        except MemoryError:
            if len(cuts) == 1:
                raise
            for half in (cuts[: len(cuts) // 2], cuts[len(cuts) // 2 :]):
                yield from windows(b, i, bank, w, half, attempts + 1)
            return
        rows = len(cuts) * len(freqs)
        cols = [b.column(c).take(pa.array(np.full(rows, i, dtype="i4"))) for c in own]
        cols += [pa.array(np.repeat([ev[c] for ev, _ in cuts], len(freqs)), t) for c, t in (("size", pa.float64()), ("event_idx", pa.int32()))]
        cols += [pa.array(np.tile(np.arange(len(freqs), dtype="i4"), len(cuts))), pa.array(np.tile(freqs, len(cuts)))]
        cols += [pa.ListArray.from_arrays(np.arange(rows + 1, dtype="i4") * n, out.ravel()), pa.nulls(rows, pa.string()), pa.array(np.full(rows, attempts, dtype="i4"))]
        yield pa.RecordBatch.from_arrays(cols, names=types.names)

    def run(batches):
        banks: dict[float, Wavelets] = {}
        for b in batches:
            for i in range(b.num_rows):
                try:
                    fs, t0, first, length, attempts = (b.column(c)[i].as_py() for c in ("fs", "t0", "first", "n", "attempts"))
                    w = b.column("w")[i].values.to_numpy(zero_copy_only=False).astype(float)
                    times = t0 + (first + np.arange(len(w))) / fs
                    ends = (t0 + np.zeros(1) / fs)[0], (t0 + np.array([length - 1]) / fs)[0]
                    bank = banks.get(fs) or banks.setdefault(fs, Wavelets(freqs, fs, n_cycles))
                    cuts = []
                    for ev in b.column("ev")[i].as_py():
                        cut = window_slice(times, ev["e"], config.half, n, ends)
                        if cut is not None:
                            cuts.append((ev, cut))
                    for k in range(0, len(cuts), step):
                        yield from windows(b, i, bank, w, cuts[k : k + step], attempts)
                except Exception as e:  # noqa: BLE001  a bad block is a row
                    values = [*[pa.nulls(1, t) for t in (pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))], pa.array([f"{type(e).__name__}: {e}"]), pa.nulls(1, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in own], *values], names=types.names)

    bad = signals.select(*own).distinct().join(stats.where("error IS NOT NULL").select(*CHANNEL, "error", "attempts"), CHANNEL)
    bad = bad.select(*own, *[F.lit(None).cast(types[c].dataType).alias(c) for c in ("size", "event_idx", "f_idx", "freq", "w")], "error", "attempts")
    return ready.mapInArrow(run, types).unionByName(bad)


def needs_z(config: AnalysisConfig) -> bool:
    """Whether power is z-scored over the whole recording before windows are normalized: by choice, or because there is no
    sample in the baseline."""
    from ..functions.columns import axis_range

    empty = config.normalization == "baseline_per_event" and not axis_range(config.samples, config.half, *config.baseline)
    return config.normalization == "channel_global" or config.normalization != "none" and config.baseline_input == "zscored" or empty


def window_slice(times: np.ndarray, e: float, half: float, n: int, ends: tuple[float, float] | None = None) -> np.ndarray | None:
    """Positions of the n samples of an event's window: [e - half, e + half) trimmed at both ends or padded with its edges;
    None if the window leaves the recording, whose first and last times are ends where times are a part of it."""
    if not len(times):
        return None
    first, last = ends or (times[0], times[-1])
    if e - half < first or e + half > last:
        return None
    a, b = np.searchsorted(times, [e - half, e + half])
    if a >= b:
        return None
    size = b - a
    start = (size - n) // 2 if size >= n else -((n - size) // 2)
    return np.clip(np.arange(n) + start, 0, size - 1) + a


def spectral_moments(signals: DataFrame, config: AnalysisConfig, size: int = BLOCK, budget: float = BUDGET) -> DataFrame:
    """(subject, session, channel_idx, n, mu, sd, attempts, error): mean and spread of each frequency's Morlet power over whole
    recordings, worked out block by block."""
    freqs = np.array(config.grid())
    n_cycles = cycles(freqs, config.cycles, config.cycles_fixed, config.cycles_factor, config.cycles_min)
    reach = [Wavelets(freqs, r["fs"], n_cycles) for r in signals.select("fs").distinct().collect()]  # few sampling rates
    before, after = (max((getattr(r, c) for r in reach), default=0) for c in ("before", "after"))
    return recording_moments(block_moments(cut_blocks(signals, size, before, after), size, config, budget), size)
