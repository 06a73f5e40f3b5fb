"""Event-locked z-scores on streams, from state kept per recording.

An extension.  A window is sent on when the watermark passes its end, so that all its samples are there; its z is against the
mean and population spread of the recording's samples up to that end.  What is older than any open or coming window is
folded into running moments, so state holds a window's length and the allowed lateness of samples, not the recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import STD_FLOOR

DOUBLE, LONG = T.DoubleType(), T.LongType()
OUT = "subject string, event_id long, e timestamp, ts timestamp, v double, z double"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def merged_moments(n: float, mean: float, m2: float, x: np.ndarray) -> tuple[float, float, float]:
    """(count, mean, sum of squared deviations) of what (n, mean, m2) describes and x together."""
    if not len(x):
        return n, mean, m2
    k, d = len(x), x.mean() - mean
    total = n + k
    return total, mean + d * k / total, m2 + ((x - x.mean()) ** 2).sum() + d * d * n * k / total


class WindowProcessor(StatefulProcessor):
    """State of a recording: running moments, samples not yet folded into them, events whose window is open."""

    def __init__(self, half_us: int):
        self.half = half_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", _struct(n=DOUBLE, mean=DOUBLE, m2=DOUBLE, first=LONG))
        self.samples = handle.getListState("samples", _struct(t=LONG, v=DOUBLE))
        self.events = handle.getListState("events", _struct(event_id=LONG, e=LONG))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            is_event = batch["event_id"].notna()
            fresh = [(int(t), float(v)) for t, v in zip(batch["t"][~is_event], batch["v"][~is_event], strict=True)]
            if fresh:
                self.samples.appendList(fresh)
                state = self.moments.get() if self.moments.exists() else (0.0, 0.0, 0.0, fresh[0][0])
                self.moments.update((*state[:3], min(state[3], min(t for t, _ in fresh))))
            opened = [(int(i), int(e)) for i, e in zip(batch["event_id"][is_event], batch["t"][is_event], strict=True)]
            if opened:
                self.events.appendList(opened)
                for _, e in opened:
                    self.handle.registerTimer((e + self.half) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        events = list(self.events.get()) if self.events.exists() else []
        due = [x for x in events if (x[1] + self.half) // 1000 + 1 <= until]
        if not due or not self.moments.exists():
            return
        left = [x for x in events if x not in due]
        n, mean, m2, first = self.moments.get()
        held = np.array(sorted((t, v) for t, v in self.samples.get()) if self.samples.exists() else [], dtype=[("t", "i8"), ("v", "f8")])
        for event_id, e in sorted(due, key=lambda x: (x[1], x[0])):
            if e - self.half < first:
                continue
            before = held[held["t"] < e + self.half]
            own = before[before["t"] >= e - self.half]
            count, mu, squares = merged_moments(n, mean, m2, before["v"])
            sd = max(np.sqrt(squares / count) if count else 0.0, STD_FLOOR)
            yield pd.DataFrame({"subject": key[0], "event_id": event_id, "e": pd.to_datetime(e, unit="us"), "ts": pd.to_datetime(own["t"], unit="us"), "v": own["v"], "z": (own["v"] - mu) / sd})
        self.events.put(left) if left else self.events.clear()
        # events that still come are at the watermark at least
        keep = min([timerValues.getCurrentWatermarkInMs() * 1000, *[e for _, e in left]]) - self.half
        old = held[held["t"] < keep]
        if len(old):
            self.moments.update((*map(float, merged_moments(n, mean, m2, old["v"])), first))
            rest = [(int(t), float(v)) for t, v in held[held["t"] >= keep]]
            self.samples.put(rest) if rest else self.samples.clear()

    def close(self) -> None:
        pass


def stream_normalized_windows(events: DataFrame, samples: DataFrame, half_seconds: float, late: str = "10 seconds") -> DataFrame:
    """(subject, event_id, e, ts, v, z) of the samples (subject, ts, v) in [e - half, e + half) of each of events (subject,
    event_id, ts).  Events whose window begins before the recording's first sample are dropped, as is what comes later than
    the watermark.  Needs the RocksDB state store."""
    s = samples.select(F.col("subject").cast("string").alias("subject"), "ts", F.col("v").cast("double").alias("v"), F.lit(None).cast("long").alias("event_id"))
    e = events.select(F.col("subject").cast("string").alias("subject"), "ts", F.lit(None).cast("double").alias("v"), F.col("event_id").cast("long").alias("event_id"))
    both = s.unionByName(e).withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return both.groupBy("subject").transformWithStateInPandas(WindowProcessor(round(half_seconds * 1e6)), OUT, "append", "eventTime")
