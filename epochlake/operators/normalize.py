"""Normalizations of power against a recording, a window or a pre-event baseline.

Windows are rows (keys..., event, w array<double>) or recordings (keys..., v).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STD_FLOOR
from ..functions.columns import axis_range, bind, floored


def global_statistics(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean and floored population spread over the whole recording."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("mu"), floored(F.stddev_pop(value)).alias("sd"), F.count(value).alias("n"))


def channel_global(samples: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """z of every sample over its whole recording: statistics are pre-aggregated, then joined back."""
    return samples.join(global_statistics(samples, keys, value), keys).withColumn("z", (F.col(value) - F.col("mu")) / F.col("sd"))


def array_mean(w: Column, ks: list[int]) -> Column:
    """Mean of the values of w at the positions ks (a run)."""
    part = F.slice(w, ks[0] + 1, len(ks))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(ks)))


def array_std(w: Column, ks: list[int]) -> Column:
    """Floored population spread of the values of w at the positions ks (a run)."""
    part = F.slice(w, ks[0] + 1, len(ks))
    square = lambda m: F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return floored(F.sqrt(bind(array_mean(w, ks), square) / F.lit(float(len(ks)))))


def _standardized(w: Column, mu: Column, sd: Column) -> Column:
    return bind(mu, lambda m: bind(sd, lambda s: F.transform(w, lambda x: (x - m) / s)))


def baseline_statistics(windows: DataFrame, keys: list[str], n: int, half: float, baseline: tuple[float, float], min_events: int = 3) -> DataFrame:
    """Per key: mean and spread over events of each event's baseline mean, counts and warnings."""
    ks = axis_range(n, half, *baseline)
    if not ks:
        raise ValueError(f"no sample in the baseline {baseline}")
    per = windows.select(*keys, array_mean(F.col("w"), ks).alias("b"))
    raw = F.stddev_pop("b")
    out = per.groupBy(*keys).agg(F.avg("b").alias("mu"), floored(raw).alias("sd"), F.count("b").alias("n_events"), raw.alias("raw"))
    few = F.when(F.col("n_events") < min_events, F.array(F.lit("few_events"))).otherwise(F.array().cast("array<string>"))
    tiny = F.when(F.col("raw") < 1e-6, F.array(F.lit("tiny_std"))).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "mu", "sd", "n_events", F.lit(len(ks)).alias("n_baseline_samples"), F.concat(few, tiny).alias("warnings"))


def baseline_cross_event(windows: DataFrame, keys: list[str], n: int, half: float, baseline: tuple[float, float]) -> DataFrame:
    """w as z against the cross-event baseline of its keys; a key without statistics is an error."""
    stats = baseline_statistics(windows, keys, n, half, baseline).select(*keys, "mu", "sd")
    joined = windows.join(stats, keys, "left")
    mu = F.when(F.col("mu").isNull(), F.raise_error(F.lit("baseline statistics missing")).cast("double")).otherwise(F.col("mu"))
    return joined.withColumn("w", F.transform("w", lambda x: (x - mu) / F.col("sd"))).drop("mu", "sd")


def baseline_per_event(windows: DataFrame, n: int, half: float, baseline: tuple[float, float], stats: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """w as z against its own event's baseline; if no sample is in the baseline, against the recording's statistics
    (keys, mu, sd), without which that is an error."""
    ks = axis_range(n, half, *baseline)
    if not ks:
        if stats is None or keys is None:
            raise ValueError(f"no sample in the baseline {baseline}")
        return window_global(windows, stats, keys)
    return windows.withColumn("w", _standardized(F.col("w"), array_mean(F.col("w"), ks), array_std(F.col("w"), ks)))


def window_global(windows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """w as z by supplied statistics (keys, mu, sd)."""
    return windows.join(stats.select(*keys, "mu", "sd"), keys).withColumn("w", F.transform("w", lambda x: (x - F.col("mu")) / F.col("sd"))).drop("mu", "sd")


def trial(windows: DataFrame, ks: list[int] | None = None, eps: float = STD_FLOOR) -> DataFrame:
    """w as z of a single trial against its samples ks (all by default), eps added to the population spread."""
    part = F.col("w") if ks is None else F.slice("w", ks[0] + 1, len(ks))
    n = F.size("w") if ks is None else F.lit(len(ks))
    mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n
    square = bind(mean, lambda m: F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    return windows.withColumn("w", _standardized(F.col("w"), mean, F.sqrt(square / n) + eps))
