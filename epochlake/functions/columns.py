"""Column expressions and frequency grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STD_FLOOR


def floored(sd: Column) -> Column:
    """A spread to divide by: at least STD_FLOOR, and STD_FLOOR where there is none."""
    return F.greatest(F.coalesce(sd, F.lit(0.0)), F.lit(STD_FLOOR))


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once: inside an array function a plain expression would be per element."""
    return F.transform(F.array(value), body)[0]


def axis_time(k: Column, n: int, half: float) -> Column:
    """Time of sample k of n on the axis from -half to +half, both ends included."""
    return F.lit(-half) + F.lit(2.0 * half) * k / F.lit(float(n - 1))


def axis_range(n: int, half: float, lo: float, hi: float) -> list[int]:
    """Samples of that axis within [lo, hi]."""
    return [k for k in range(n) if lo <= -half + 2.0 * half * k / (n - 1) <= hi]


def time_slice(w: Column, fs: float, lo: float, hi: float, t0: float = 0.0, required: bool = False) -> Column:
    """Values of w, sampled at t0 + k / fs, with time in the closed [lo, hi]; if required, an empty one is an error."""
    out = F.filter(w, lambda x, k: (F.lit(t0) + k / F.lit(fs)).between(lo, hi))
    if required:
        out = F.when(F.size(out) > 0, out).otherwise(F.raise_error(F.lit(f"no sample in [{lo}, {hi}] s")).cast("array<double>"))
    return out


def n_cycles(f: Column, method: str = "custom", fixed: float = 5.0, factor: float = 1.0, least: float = 6.0) -> Column:
    """Wavelet cycles at a frequency."""
    if method == "fixed":
        return F.lit(float(fixed))
    if method == "adaptive":
        return f * factor
    if method == "hybrid":
        return F.greatest(F.lit(float(least)), f * factor)
    if method == "custom":
        return F.when(f.between(3.0, 7.0), 3.0 + (f - 3.0) / 4.0).otherwise(3.0)
    raise ValueError(f"unknown cycles policy {method!r}")


def grid_array(lo: float, hi: float, n: int) -> Column:
    """n frequencies in equal ratios as an array, both ends exact."""
    inner = lambda i: F.lit(lo) * F.pow(F.lit(hi / lo), i / F.lit(float(max(n - 1, 1))))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 0, F.lit(lo)).when(i == n - 1, F.lit(hi)).otherwise(inner(i)))


def geometric_grid(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(f_idx, freq): grid_array as rows."""
    return spark.range(1).select(F.posexplode(grid_array(lo, hi, n)).alias("f_idx", "freq"))


def select_frequencies(freqs: DataFrame, lo: float, hi: float, extended: bool = False) -> DataFrame:
    """Frequencies within [lo, hi], with the nearest one on each side if extended."""
    f = F.col("freq")
    inside = freqs.where(f.between(lo, hi)).select("freq")
    if extended:
        edges = freqs.agg(F.max(F.when(f < lo, f)).alias("a"), F.min(F.when(f > hi, f)).alias("b"))
        inside = inside.unionByName(edges.select(F.explode(F.array("a", "b")).alias("freq")).where(f.isNotNull()))
    return inside
