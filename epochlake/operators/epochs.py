"""Event-locked windows: interval joins of events with samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import floored
from ..sources.sinks import staged
from .ranks import quantiles


def bounded_events(events: DataFrame, samples: DataFrame, half: int | float, keys: list[str]) -> DataFrame:
    """Events whose whole window [e - half, e + half] lies within their recording's first and last sample."""
    span = samples.groupBy(*keys).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    return events.join(span, keys).where((F.col("e") - half >= F.col("t_first")) & (F.col("e") + half <= F.col("t_last"))).drop("t_first", "t_last")


def event_windows(events: DataFrame, samples: DataFrame, half: int | float, keys: list[str]) -> DataFrame:
    """Samples t in [e - half, e + half) of every event, with dt = t - e.

    The interval join is an equi-join on the keys and a time bucket as wide as the window: a sample has one bucket, an
    event the two it touches.  So a long recording is split over tasks, and no task compares an event with the whole of it.
    """
    width = 2 * half
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    s = samples.withColumn("bucket", bucket(F.col("t")))
    e = events.withColumn("bucket", F.explode(F.sequence(bucket(F.col("e") - half), bucket(F.col("e") + half))))
    joined = e.join(s, [*keys, "bucket"]).where((F.col("t") >= F.col("e") - half) & (F.col("t") < F.col("e") + half))
    return joined.withColumn("dt", F.col("t") - F.col("e")).drop("bucket")


def window_arrays(windows: DataFrame, by: list[str]) -> DataFrame:
    """One row per event with its values in time order (a window is bounded by its length)."""
    ordered = F.sort_array(F.collect_list(F.struct("t", "v")))
    return windows.groupBy(*by).agg(ordered.alias("w")).select(*by, F.transform("w", lambda x: x["v"]).alias("w"))


def trim_or_pad(w: Column, n: int) -> Column:
    """w cut at both ends, or padded with its edge values, to n values; of an odd excess one more goes at the end."""
    size = F.size(w)
    start = F.when(size >= n, F.floor((size - n) / 2)).otherwise(-F.floor((F.lit(n) - size) / 2)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(w, F.least(F.greatest(k + start, F.lit(0)), size - 1).cast("int") + 1))


def pad_end(w: Column, n: int) -> Column:
    """w truncated to n values or padded with its last one."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at(w, F.least(k, F.size(w) - 1) + 1))


def within_tolerance(size: Column, expected: int, least: int = 10, share: float = 0.05) -> Column:
    return F.abs(size - expected) <= max(least, int(expected * share))


#: Samples of a recording that one task should hold.
BUCKET_SAMPLES = 100_000


def time_bucket(samples: DataFrame, keys: list[str], per_bucket: int = BUCKET_SAMPLES) -> float:
    """A width of time buckets so that the longest recording has about per_bucket samples in each."""
    per = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    n, span = per.agg(F.max("n"), F.max("span")).first()
    return float(span or 1) / max(1, -(-(n or 1) // per_bucket)) or 1.0


#: Cuts of a dense bucket at most; beyond that many times BUCKET_SAMPLES its parts grow.
MOST_CUTS = 2_000
#: Values of all cuts up to which they are broadcast.
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class TimeCuts:
    """How recordings are cut into time buckets: even ones of `width`, and those that hold a burst of samples again at `edges`
    (keys, bucket, edges), a written table; None where there is no burst."""

    keys: list[str]
    width: float
    edges: DataFrame | None = None
    few: bool = True

    def of(self, df: DataFrame, time: Column) -> DataFrame:
        """df with bucket, a pair that is ordered as time is; rows of one time share theirs, rows without a time are left out."""
        even = F.floor(time / F.lit(self.width)).cast("long")
        if self.edges is None:
            return df.where(time.isNotNull()).withColumn("bucket", F.struct(even.alias("even"), F.lit(0).alias("part")))
        marked = df.where(time.isNotNull()).select("*", time.alias("of_time"), even.alias("of_even"))
        edges = self.edges.select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(self.keys)], F.col("bucket").alias("of_bucket"), F.col("edges").alias("of_edges"))
        edges = F.broadcast(edges) if self.few else edges
        same = [F.col(k) == F.col(f"of_{i}") for i, k in enumerate(self.keys)]
        part = F.when(F.col("of_edges").isNull(), 0).otherwise(F.size(F.filter("of_edges", lambda x: x <= F.col("of_time"))))
        joined = marked.join(edges, [*same, F.col("of_even") == F.col("of_bucket")], "left")
        return joined.select(*df.columns, F.struct(F.col("of_even").alias("even"), part.alias("part")).alias("bucket"))


def time_cuts(samples: DataFrame, keys: list[str], width: float | None = None, per_bucket: int = BUCKET_SAMPLES) -> TimeCuts:
    """Cuts that leave about per_bucket samples in a bucket, in bursts too: buckets with more than twice as many are cut again at
    quantiles of their times.  The edges come from a sketch and are written, so every use of them sees the same; where they lie
    decides how even the tasks are, never a result."""
    width = float(width or time_bucket(samples, keys, per_bucket))
    even = samples.select(*keys, F.col("t").cast("double").alias("t"), F.floor(F.col("t") / F.lit(width)).cast("long").alias("bucket"))
    dense = even.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * per_bucket)
    most, rows = dense.agg(F.max("n"), F.count(F.lit(1))).first()
    if most is None:
        return TimeCuts(keys, width)
    n = min(-(-most // per_bucket), MOST_CUTS)
    few = rows * n <= MOST_SENT
    dense = dense.drop("n")
    held = even.join(F.broadcast(dense) if few else dense, [*keys, "bucket"], "left_semi")
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    edges = held.groupBy(*keys, "bucket").agg(F.array_distinct(F.percentile_approx("t", at, 10 * n)).alias("edges"))
    return TimeCuts(keys, width, staged(edges, "time-cuts"), few)


def nearest_sample(events: DataFrame, samples: DataFrame, keys: list[str], width: float | None = None, per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """(events' columns, t, v) of the sample nearest in time, the earlier on a tie; events of keys without samples are absent.

    Recordings are split into time buckets, so no task holds a whole one: within a bucket the last sample up to, and the
    first from, each event are running values (one ascending and one descending pass); the last sample before a bucket and
    the first after it come from the buckets' ends, one row a bucket.
    """
    return _nearest(events, samples, keys, time_cuts(samples, keys, width, per_bucket))


def _nearest(events: DataFrame, samples: DataFrame, keys: list[str], cuts: TimeCuts) -> DataFrame:
    cols = [c for c in events.columns if c not in keys]
    pair = F.struct(F.col("t"), F.col("v"))
    s = cuts.of(samples, F.col("t")).select(*keys, "bucket", F.col("t").alias("at"), pair.alias("s"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in cols])
    e = cuts.of(events, F.col("e")).select(*keys, "bucket", F.col("e").alias("at"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), *cols)
    ends = s.unionByName(e).groupBy(*keys, "bucket").agg(F.min("s").alias("head"), F.max("s").alias("tail"))
    buckets = Window.partitionBy(*keys)
    rest = (Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "bucket", F.last("tail", True).over(buckets.orderBy("bucket").rowsBetween(*rest)).alias("earlier"), F.last("head", True).over(buckets.orderBy(F.desc("bucket")).rowsBetween(*rest)).alias("later"))
    inside = Window.partitionBy(*keys, "bucket")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    both = s.unionByName(e).withColumn("before", F.last("s", True).over(inside.orderBy("at").rangeBetween(*so_far))).withColumn("after", F.last("s", True).over(inside.orderBy(F.desc("at")).rangeBetween(*so_far)))
    both = both.where(F.col("e").isNotNull()).join(ends, [*keys, "bucket"])
    before, after = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    both = both.withColumn("before", before).withColumn("after", after)
    nearer = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("e") - F.col("before.t") <= F.col("after.t") - F.col("e"), F.col("before")).otherwise(F.col("after"))
    return both.withColumn("n", nearer).where(F.col("n").isNotNull()).select(*events.columns, F.col("n.t").alias("t"), F.col("n.v").alias("v"))


def numbered_samples(samples: DataFrame, keys: list[str], width: float | None = None, per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """samples with i, their 0-based number in time within the recording: a number within each time bucket and the count of
    the buckets before it."""
    return _numbered(samples, keys, time_cuts(samples, keys, width, per_bucket))


def _numbered(samples: DataFrame, keys: list[str], cuts: TimeCuts) -> DataFrame:
    b = cuts.of(samples, F.col("t"))
    counts = b.groupBy(*keys, "bucket").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("t"))
    return b.withColumn("i", own - 1).join(starts, [*keys, "bucket"]).withColumn("i", F.col("i") + F.col("start")).drop("bucket", "start")


def nearest_windows(events: DataFrame, samples: DataFrame, n: int, keys: list[str], width: float | None = None, per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """(events' columns, k, t, v): n samples around the sample nearest to each event, from n // 2 before it on (from the first
    one where fewer precede it); windows that the recording's end would shorten are dropped."""
    cuts = time_cuts(samples, keys, width, per_bucket)
    numbered = _numbered(samples, keys, cuts)
    at = _nearest(events, numbered.select(*keys, "t", F.col("i").alias("v")), keys, cuts)
    first = F.greatest(F.col("v") - n // 2, F.lit(0))
    size = samples.groupBy(*keys).agg(F.count("t").alias("size"))
    starts = at.withColumn("first", first).join(size, keys).where(F.col("first") + n <= F.col("size")).select(*events.columns, "first")
    cols = [c for c in events.columns if c not in keys]
    spans = starts.select(*keys, F.struct(*cols).alias("ev"), "first", (F.col("first") + n / 2).alias("e"))
    cut = event_windows(spans, numbered.select(*keys, F.col("i").alias("t"), F.struct("t", "v").alias("s")), n / 2, keys)
    return cut.select(*keys, *[F.col(f"ev.{c}").alias(c) for c in cols], (F.col("t") - F.col("first")).cast("int").alias("k"), F.col("s.t").alias("t"), F.col("s.v").alias("v"))


def baseline_z(windows: DataFrame, unit: list[str], event: list[str], base: Column, response: Column, min_events: int) -> DataFrame:
    """Per unit the mean z of response samples against the cross-event baseline: each event's baseline is averaged over
    time first, then mean and spread are taken over the events of the unit.  Units with fewer than min_events are left out."""
    per_event = windows.groupBy(*unit, *event).agg(F.avg(F.when(base, F.col("v"))).alias("b"), F.sum(F.when(response, F.col("v"))).alias("s"), F.count(F.when(response, F.col("v"))).alias("n"))
    per_unit = per_event.groupBy(*unit).agg(F.avg("b").alias("mu"), floored(F.stddev_pop("b")).alias("sd"), F.count("b").alias("n_events"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per_unit.where((F.col("n_events") >= min_events) & (F.col("n") > 0)).select(*unit, "n_events", ((F.col("s") / F.col("n") - F.col("mu")) / F.col("sd")).alias("z"))


def sampling_interval(samples: DataFrame, keys: list[str], width: float | None = None, per_bucket: int = BUCKET_SAMPLES) -> DataFrame:
    """Median step between neighbouring samples of each recording; the step into a time bucket comes from the buckets' ends."""
    b = time_cuts(samples, keys, width, per_bucket).of(samples, F.col("t"))
    ends = b.groupBy(*keys, "bucket").agg(F.max("t").alias("last"))
    ends = ends.select(*keys, "bucket", F.lag("last").over(Window.partitionBy(*keys).orderBy("bucket")).alias("earlier"))
    before = F.lag("t").over(Window.partitionBy(*keys, "bucket").orderBy("t"))
    steps = b.withColumn("before", before).join(ends, [*keys, "bucket"]).withColumn("step", F.col("t") - F.coalesce("before", "earlier"))
    q = quantiles(steps, keys, "step", [0.5]).select(*[F.col(k).alias(f"q_{k}") for k in keys], F.col("n").alias("steps"), F.col("q")[0].alias("interval"))
    same = [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys]
    return steps.select(*keys).distinct().join(q, same, "left").select(*keys, "interval", F.coalesce("steps", F.lit(0)).cast("long").alias("n"))
