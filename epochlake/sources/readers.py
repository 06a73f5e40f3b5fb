"""Sources: recordings, montages, frequency lists, result folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.montage import unpivot_montage
from .matlab import mat_cells

SIGNALS = "subject string, session string, channel_idx int, fs double, t0 double, samples array<double>"
EVENTS = "subject string, session string, event_idx int, kind string, t double, size double"


def recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(signals, events) of a dataset written by sinks.write_recordings; a filter on subject prunes partitions."""
    return spark.read.schema(SIGNALS).parquet(f"{path}/signals"), spark.read.schema(EVENTS).parquet(f"{path}/events")


def sessions_of(df: DataFrame, subject: str) -> DataFrame:
    """Rows of one subject; ValueError if there are none."""
    out = df.where(F.col("subject") == str(subject))
    if out.isEmpty():
        raise ValueError(f"no session of subject {subject}")
    return out


def session_at(df: DataFrame, index: int) -> DataFrame:
    """Rows of the session at a position in the order of (subject, session); IndexError outside."""
    names = df.select("subject", "session").distinct().orderBy("subject", "session").offset(index).limit(1)
    if index < 0 or names.isEmpty():
        raise IndexError(f"no session {index}")
    return df.join(F.broadcast(names), ["subject", "session"])


def montage_csv(spark: SparkSession, path: str, subject: str = "rat_id") -> DataFrame:
    """(subject, channel_idx, electrode) of a wide CSV with ch_* columns; the text None marks absent channels."""
    return unpivot_montage(spark.read.option("header", True).option("nullValue", "None").csv(path), subject)


def frequency_text(spark: SparkSession, path: str) -> DataFrame:
    """(freq) of a text file with one number per line; blank and non-numeric lines are skipped, an empty list is an error."""
    out = spark.read.text(path).select(F.expr("try_cast(trim(value) AS double)").alias("freq")).where("freq IS NOT NULL")
    if out.isEmpty():
        raise ValueError(f"no frequency in {path}")
    return out


def every_second(freqs: DataFrame) -> DataFrame:
    """(f_idx, freq) with even f_idx."""
    return freqs.where(F.col("f_idx") % 2 == 0)


def decode_chars(codes: Column) -> Column:
    """Text of an array of character codes, without code 0."""
    return F.array_join(F.transform(F.filter(codes, lambda c: c != 0), lambda c: F.char(c)), "")


def results(spark: SparkSession, path: str, required: list[str], skip: bool = False) -> DataFrame:
    """Results under subject=*/session=*/ folders (ids come from the folder names); ValueError if a column is missing.

    With skip, sessions whose files lack a required column, or hold nothing in it, are left out; a column that no file has
    is an error all the same."""
    out = spark.read.option("basePath", path).option("mergeSchema", skip).parquet(path)
    if gone := [c for c in required if c not in out.columns]:
        raise ValueError(f"results lack {gone}")
    if not skip:
        return out
    full = out.groupBy("subject", "session").agg(F.least(F.lit(1), *[F.count(c) for c in required]).alias("full")).where("full > 0")
    return out.join(full.select("subject", "session"), ["subject", "session"], "left_semi")


#: Cells of a session file, in order.
SESSION_CELLS = ["subject", "session", "eeg", "eeg_time", "velocity", "velocity_time", "event_times", "event_sizes", "control_times", "control_sizes"]


def mat_sessions(spark: SparkSession, path: str, cell: str = "Data_eeg") -> DataFrame:
    """One row per MATLAB session file (level 5 or 7.3), a file that can't be read, or lacks cells, as a row with error.

    The cells of a row: subject, date, signal (channels by samples), its times, velocity, its times, event times, sizes,
    control times, sizes.
    """
    cells = mat_cells(spark, path, cell)
    n = len(SESSION_CELLS)
    at = F.col("row") + F.col("col")  # the ten cells are one row or one column
    pick = lambda i, c: F.max(F.when(at == i, F.col(c)))
    each = cells.groupBy("path").agg(F.count("row").alias("n"), F.min("error").alias("bad"), F.max(F.when(at == 2, F.col("shape")[0])).alias("channels"), *[pick(i, "v").alias(c) for i, c in enumerate(SESSION_CELLS)])
    error = F.coalesce("bad", F.when(F.col("n") < n, F.concat(F.lit("ValueError: "), F.col("n"), F.lit(f" cells of {n}"))))
    samples = F.when(F.col("channels") > 0, (F.size("eeg") / F.col("channels")).cast("int")).otherwise(0)
    channel = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: F.transform(F.sequence(F.lit(0), samples - 1), lambda k: F.get("eeg", k * F.col("channels") + c)))
    eeg = F.when(samples > 0, channel).otherwise(F.array().cast("array<array<double>>"))
    code = lambda c: decode_chars(F.transform(c, lambda x: x.cast("int")))
    out = each.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select("path", *[F.when(ok, code(F.col(c))).alias(c) for c in SESSION_CELLS[:2]], F.when(ok, eeg).alias("eeg"), *[F.when(ok, F.col(c)).alias(c) for c in SESSION_CELLS[3:]], "error")


def mat_placements(spark: SparkSession, path: str, cell: str = "eeg_channels") -> DataFrame:
    """(path, subject, session, map array<int>, error) of electrode placement files: a row of cells per session, with subject,
    session and electrode numbers in its first three; montage.consistent_montage takes the rows without error."""
    cells = mat_cells(spark, path, cell)
    pick = lambda i: F.max(F.when(F.col("col") == i, F.col("v")))
    code = lambda i: decode_chars(F.transform(pick(i), lambda x: x.cast("int")))
    out = cells.groupBy("path", "row").agg(code(0).alias("subject"), code(1).alias("session"), F.transform(pick(2), lambda x: x.cast("int")).alias("map"), F.min("error").alias("error"))
    return out.select("path", "subject", "session", "map", "error")


def mat_frequencies(spark: SparkSession, path: str, variable: str = "frq") -> DataFrame:
    """(f_idx, freq) of a MATLAB file's frequency list; ValueError where it can't be read."""
    cells = mat_cells(spark, path, variable)
    bad = cells.where("error IS NOT NULL").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['error']}")
    return cells.select(F.posexplode("v").alias("f_idx", "freq"))


def mat_recordings(sessions: DataFrame, fs: float = 200.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signals, events, velocity (subject, session, t, v), failures (path, error)) of mat_sessions' rows.

    The sampling rate is that of a session's own times, fs where it has fewer than two; events are of kind nm, controls of
    kind iti, both numbered in the order of the file.  One row a channel: no task holds more than a session.
    """
    ok = sessions.where("error IS NULL")
    t, n = F.col("eeg_time"), F.size("eeg_time")
    rate = F.coalesce(F.when(n > 1, F.try_divide(n - 1, F.element_at(t, -1) - F.get(t, F.lit(0)))), F.lit(fs))
    channels = ok.select("subject", "session", F.round(rate, 6).alias("fs"), F.coalesce(F.get(t, F.lit(0)), F.lit(0.0)).alias("t0"), F.posexplode("eeg").alias("channel_idx", "samples"))

    def of_kind(kind: str, times: str, sizes: str) -> DataFrame:
        each = ok.select("subject", "session", F.posexplode(F.arrays_zip(F.col(times).alias("t"), F.col(sizes).alias("size"))).alias("event_idx", "e"))
        return each.select("subject", "session", "event_idx", F.lit(kind).alias("kind"), "e.t", "e.size")

    events = of_kind("nm", "event_times", "event_sizes").unionByName(of_kind("iti", "control_times", "control_sizes"))
    speed = ok.select("subject", "session", F.explode(F.arrays_zip(F.col("velocity_time").alias("t"), F.col("velocity").alias("v"))).alias("x")).select("subject", "session", "x.t", "x.v")
    names = [c.split()[0] for c in SIGNALS.split(", ")]
    return channels.select(names), events.where("t IS NOT NULL"), speed, sessions.where("error IS NOT NULL").select("path", "error")
