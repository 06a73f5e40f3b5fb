"""Event-locked windows on streams: a stream-stream interval join with watermarks on both sides.

An extension: normalization across events needs all of them and so stays a batch or foreachBatch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_event_windows(events: DataFrame, samples: DataFrame, half: str = "1 second", late: str = "10 seconds", key: str = "subject") -> DataFrame:
    """Samples (key, ts, v) within [event - half, event + half) of events (key, event_id, ts); state is bounded by the watermarks."""
    e = events.withWatermark("ts", late).select(F.col(key).alias("e_key"), "event_id", F.col("ts").alias("event_ts"))
    s = samples.withWatermark("ts", late)
    h = F.expr(f"INTERVAL {half}")
    return s.join(e, (F.col(key) == F.col("e_key")) & (F.col("ts") >= F.col("event_ts") - h) & (F.col("ts") < F.col("event_ts") + h)).drop("e_key")


def window_means(samples: DataFrame, width: str = "10 seconds", late: str = "10 seconds", key: str = "subject") -> DataFrame:
    """Mean and count per key and tumbling window; rows later than the watermark are dropped."""
    return samples.withWatermark("ts", late).groupBy(key, F.window("ts", width)).agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
