"""Averages along event, session, subject and population; band power and its standard error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import quantiles


def event_weighted(events: DataFrame, subject: list[str], value: str, session: str) -> DataFrame:
    """Mean over all events of a subject: each session weighs as its events."""
    return events.groupBy(*subject).agg(F.avg(value).alias("mean"), F.count(value).alias("n_events"), F.count_distinct(session).alias("n_sessions"))


def session_weighted(events: DataFrame, subject: list[str], value: str, session: str) -> DataFrame:
    """Mean of session means: each session weighs the same."""
    per = events.groupBy(*subject, session).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return per.groupBy(*subject).agg(F.avg("m").alias("mean"), F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_sessions"))


def population_mean(subjects: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Unweighted mean over subjects, with totals."""
    return subjects.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n_subjects"), F.sum("n_events").alias("n_events"), F.sum("n_sessions").alias("n_sessions"))


def weighted_mean(subjects: DataFrame, weights: DataFrame, on: list[str], keys: list[str], value: str = "mean") -> DataFrame:
    """Sum of weight * value; a subject without a weight has 0, and weights are not normalized again."""
    joined = subjects.join(weights, on, "left")
    return joined.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col(value)).alias("mean"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def equal_weights(subjects: DataFrame, keys: list[str], subject: str) -> DataFrame:
    n = subjects.groupBy(*keys).agg(F.count_distinct(subject).alias("n"))
    return subjects.select(*keys, subject).distinct().join(n, keys).select(*keys, subject, (1.0 / F.col("n")).alias("weight"), F.lit("equal").alias("method"))


def mean_and_error(subjects: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample standard error (null for one subject) and number of subjects."""
    return subjects.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def modal_shape(sessions: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """Sessions whose shape is their key's most frequent one, the smallest on a tie."""
    counts = sessions.groupBy(*keys, shape).count()
    best = counts.groupBy(*keys).agg(F.max_by(shape, F.struct(F.col("count"), -F.col(shape))).alias("modal"))
    return sessions.join(best, keys).where(F.col(shape) == F.col("modal"))


def channel_statistics(samples: DataFrame, keys: list[str], fs: float, value: str = "v") -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"), (F.count(value) / F.lit(fs)).alias("duration"))


def color_limits(cells: DataFrame, value: str, percent: float = 95.0) -> DataFrame:
    """Symmetric limits: the larger magnitude of the two tail percentiles of all cells, rounded half to even at two digits; null
    without cells."""
    q = quantiles(cells, [], value, [1 - percent / 100, percent / 100])
    out = q.select(F.bround(F.greatest(F.abs(F.col("q")[0]), F.abs(F.col("q")[1])), 2).alias("vmax"))
    return out.agg(F.max("vmax").alias("vmax")).select((-F.col("vmax")).alias("vmin"), "vmax")


def percentiles(cells: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Extremes, mean, population spread and exact percentiles of each group of cells."""
    if not keys:
        return percentiles(cells.withColumn("all", F.lit(1)), ["all"], value, at).drop("all")
    one = cells.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    q = quantiles(cells, keys, value, list(at)).select(*[F.col(k).alias(f"q_{k}") for k in keys], "q")
    out = one.join(q, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys], "left")
    return out.select(*keys, "min", "max", "mean", "std", *[F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(at)])


#: Groups whose sums a task holds at a time.
HELD_GROUPS = 20_000


def window_sums(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_events, n_channels (the least), total array<double>) of windows (keys, n_channels, w), all w of one length:
    sums of the windows that a task has of each group, so that cells leave it once a group and not once an event."""
    schema = T.StructType([*[windows.schema[k] for k in keys], T.StructField("n_events", T.LongType()), T.StructField("n_channels", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def run(batches):
        held: dict[tuple, list] = {}

        def sent(types):
            cols = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            n, channels, total = zip(*held.values(), strict=True)
            ends = np.arange(len(total) + 1, dtype="i4") * len(total[0])
            return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(channels, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(total))], names=schema.names)

        types = []
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(k).type for k in keys]
            names: dict[tuple, int] = {}
            code = np.array([names.setdefault(k, len(names)) for k in zip(*[b.column(k).to_pylist() for k in keys], strict=True)])
            order = np.argsort(code, kind="stable")
            first = np.searchsorted(code[order], np.arange(len(names)))
            w = b.column("w").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            total = np.add.reduceat(w[order], first, axis=0)
            channels = np.minimum.reduceat(b.column("n_channels").to_numpy(zero_copy_only=False)[order], first)
            for k, n, c, t in zip(names, np.bincount(code).tolist(), channels.tolist(), total, strict=True):
                if k in held:
                    was = held[k]
                    held[k] = [was[0] + n, min(was[1], c), was[2] + t]
                else:
                    held[k] = [n, c, t]
            if len(held) > HELD_GROUPS:
                yield sent(types)
                held.clear()
        if held:
            yield sent(types)

    return windows.select(*keys, "n_channels", "w").mapInArrow(run, schema)


def cell_sums(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, total, n_events, n_channels): the sum over windows of each of their samples."""
    cells = window_sums(windows, keys).select(*keys, "n_events", "n_channels", F.posexplode("total").alias("k", "total"))
    return cells.groupBy(*keys, "k").agg(F.sum("total").alias("total"), F.sum("n_events").alias("n_events"), F.min("n_channels").alias("n_channels"))


def compare_methods(cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Range, mean, spread and Pearson correlation of two normalizations of the same cells."""
    one = lambda c, name: [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    return cells.groupBy(*keys).agg(*one(a, "global"), *one(b, "baseline"), F.corr(a, b).alias("r"))


def trapezoid(psd: DataFrame, keys: list[str], lo: float, hi: float) -> Column:
    """Integral over the closed band [lo, hi] of (freq, p) pairs collected per key (a spectrum is bounded)."""
    pairs = F.filter(F.sort_array(F.collect_list(F.struct("freq", "p"))), lambda x: x["freq"].between(lo, hi))
    steps = F.zip_with(F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))), lambda y, x: (x["p"] + y["p"]) / 2 * (y["freq"] - x["freq"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def band_power(psd: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    return psd.groupBy(*keys).agg(*[trapezoid(psd, keys, *b).alias(name) for name, b in bands.items()])


def peak(lo: float, hi: float) -> Column:
    """Aggregate of (freq, p): struct of the largest p in [lo, hi] and the negative of its lowest frequency (col2)."""
    return F.max(F.when(F.col("freq").between(lo, hi), F.struct(F.col("p"), -F.col("freq"))))


def peak_frequency(psd: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Frequency and power of the largest value in [lo, hi], the lowest frequency on a tie; null where the range is empty."""
    return psd.groupBy(*keys).agg(peak(lo, hi).alias("m")).select(*keys, (-F.col("m.col2")).alias("peak_freq"), F.col("m.p").alias("peak_power"))
