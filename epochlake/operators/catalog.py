"""Session catalogs, processing reports and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_summary(sessions: DataFrame, subject: str = "subject") -> DataFrame:
    """Per subject of (subject, session, length, n_events, n_control): mean length, sums and number of sessions."""
    return sessions.groupBy(subject).agg(F.avg("length").alias("mean_length"), F.sum("n_events").alias("n_events"), F.sum("n_control").alias("n_control"), F.count(F.lit(1)).alias("n_sessions"))


def describe_sessions(sessions: DataFrame, values: list[str], subject: str = "subject") -> DataFrame:
    """(subject, value, n, mean, std, min, p25, p50, p75, max) of each value column, per subject and (subject null, all true)
    over all of them, in one pass over grouping sets; std is the sample spread, quartiles are exact (sessions are few)."""
    stats = lambda c: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max(c).cast("double").alias("max"))
    out = sessions.groupingSets([[subject], []], subject).agg((F.grouping(subject) == 1).alias("all"), *[stats(c).alias(c) for c in values])
    each = out.select(subject, "all", F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).alias("s")) for c in values])).alias("x"))
    q = F.col("x.s.q")
    return each.select(subject, "all", "x.value", "x.s.n", "x.s.mean", "x.s.std", "x.s.min", q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), "x.s.max")


def extreme_sessions(sessions: DataFrame, order: list[str], value: str = "length") -> DataFrame:
    """The longest and the shortest session; of equal ones the first in order (two rows, no sort)."""
    first = F.struct(*order)
    best = sessions.agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    both = sessions.join(F.broadcast(best), F.col(value).isin(F.col("hi"), F.col("lo")))
    longest = both.where(F.col(value) == F.col("hi")).agg(F.min(F.struct(first, value)).alias("s")).select(F.lit("longest").alias("which"), "s.*")
    shortest = both.where(F.col(value) == F.col("lo")).agg(F.min(F.struct(first, value)).alias("s")).select(F.lit("shortest").alias("which"), "s.*")
    out = longest.unionByName(shortest)
    nested = out.columns[1]
    return out.select("which", *[F.col(f"{nested}.{c}").alias(c) for c in order], value)


def failure_report(runs: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Per key: runs, failures and success rate in percent."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(ok)).alias("n_failed"), (100.0 * F.count_if(F.col(ok)) / F.count(F.lit(1))).alias("success_rate"))


def missing_partitions(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def progress(expected: DataFrame, present: DataFrame, subject: str, session: str) -> DataFrame:
    """Per subject: expected and present sessions and completed, partial or failed."""
    want = expected.groupBy(subject).agg(F.count_distinct(session).alias("n_expected"))
    have = present.groupBy(subject).agg(F.count_distinct(session).alias("n_present"))
    n = F.coalesce("n_present", F.lit(0))
    state = F.when(n >= F.col("n_expected"), "completed").when(n > 0, "partial").otherwise("failed")
    return want.join(have, subject, "left").select(subject, "n_expected", n.alias("n_present"), state.alias("state"))


def subjects(sessions: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Distinct subject ids as strings, without the excluded ones."""
    s = sessions.select(F.col("subject").cast("string").alias("subject")).distinct()
    return s.where(~F.col("subject").isin(exclude)) if exclude else s


def compatible(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column, whether all results share one value."""
    return results.agg(*[(F.count_distinct(F.col(c).cast("string")) <= 1).alias(c) for c in columns])


def recording_sessions(signals: DataFrame, events: DataFrame) -> DataFrame:
    """(subject, session, length, n_channels, n_events, n_control) of each recording; the samples are not moved."""
    s = signals.groupBy("subject", "session").agg(F.max(F.size("samples")).alias("length"), F.count(F.lit(1)).alias("n_channels"))
    e = events.groupBy("subject", "session").agg(F.count_if(F.col("kind") == "nm").alias("n_events"), F.count_if(F.col("kind") == "iti").alias("n_control"))
    return s.join(e, ["subject", "session"], "left").fillna(0, ["n_events", "n_control"])


def checked_channels(signals: DataFrame, channels: list[int]) -> DataFrame:
    """signals of the channels; ValueError if the list is empty, negative or beyond a session's last channel."""
    if not channels or min(channels) < 0:
        raise ValueError(f"channels {channels}")
    short = signals.groupBy("subject", "session").agg(F.max("channel_idx").alias("last")).where(F.col("last") < max(channels))
    if (bad := short.first()) is not None:
        raise ValueError(f"channel {max(channels)} is beyond the last of session {bad['session']} of {bad['subject']}")
    return signals.where(F.col("channel_idx").isin(channels))
