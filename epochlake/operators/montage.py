"""Electrode montages: wide rows, channel look-ups, region catalogs and compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_montage(wide: DataFrame, subject: str, prefix: str = "ch_") -> DataFrame:
    """(subject, channel_idx, electrode) of a wide table with a column per channel; missing channels are left out."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(F.col(subject).cast("string").alias("subject"), *[F.col(c).cast("int") for c in cols]).unpivot("subject", cols, "ch", "electrode")
    return long.where("electrode IS NOT NULL").select("subject", F.substring("ch", len(prefix) + 1, 10).cast("int").alias("channel_idx"), "electrode")


def pivot_montage(montage: DataFrame, channels: int, prefix: str = "ch_") -> DataFrame:
    out = montage.groupBy("subject").pivot("channel_idx", list(range(channels))).agg(F.first("electrode"))
    return out.select("subject", *[F.col(str(k)).alias(f"{prefix}{k}") for k in range(channels)])


def channels_of(montage: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Channels that hold requested electrodes; electrodes a subject lacks are silently absent."""
    return montage.join(electrodes, "electrode")


def electrodes_of(montage: DataFrame, channels: DataFrame) -> DataFrame:
    return montage.join(channels, [c for c in ("subject", "channel_idx") if c in channels.columns])


def region_catalog(montage: DataFrame, regions: DataFrame) -> DataFrame:
    """(subject, region, channels in channel order); regions without channels are omitted."""
    return montage.join(regions, "electrode").groupBy("subject", "region").agg(F.sort_array(F.collect_list("channel_idx")).alias("channels"))


#: Rows of (region, electrode) at most: they are sent along with the plan.
MOST_WANTED = 100_000


def _wanted(montage: DataFrame, regions: DataFrame) -> DataFrame:
    """(subject, region, electrode) of every subject of montage; ValueError for more than MOST_WANTED rows of regions."""
    rows = regions.select("region", "electrode").distinct().limit(MOST_WANTED + 1).collect()
    if len(rows) > MOST_WANTED:
        raise ValueError(f"more than {MOST_WANTED} electrodes of regions")
    each = F.array(*[F.struct(F.lit(r["region"]).alias("region"), F.lit(r["electrode"]).alias("electrode")) for r in rows]) if rows else F.array().cast("array<struct<region:string,electrode:int>>")
    return montage.select("subject").distinct().select("subject", F.inline(each))


def missing_electrodes(montage: DataFrame, regions: DataFrame) -> DataFrame:
    """(subject, region, electrode) requested but absent."""
    return _wanted(montage, regions).join(montage.select("subject", "electrode"), ["subject", "electrode"], "left_anti").select("subject", "region", "electrode")


def compatibility(montage: DataFrame, regions: DataFrame) -> DataFrame:
    """(subject, region, n_missing, compatible): a region is compatible if no electrode of it is missing."""
    gaps = missing_electrodes(montage, regions).groupBy("subject", "region").agg(F.count(F.lit(1)).alias("gaps"))
    n = F.coalesce("gaps", F.lit(0)).cast("int")
    return _wanted(montage, regions).select("subject", "region").distinct().join(gaps, ["subject", "region"], "left").select("subject", "region", n.alias("n_missing"), (n == 0).alias("compatible"))


def consistent_montage(placements: DataFrame, channels: int) -> DataFrame:
    """Subjects all of whose complete sessions agree on one map: (subject, map)."""
    full = placements.where(F.size("map") == channels)
    return full.groupBy("subject").agg(F.collect_set("map").alias("maps")).where(F.size("maps") == 1).select("subject", F.col("maps")[0].alias("map"))


def session_montage(sessions: DataFrame, exceptions: dict[tuple[str, str], str]) -> DataFrame:
    """sessions with montage_subject: another subject's row for the (subject, date) pairs in exceptions."""
    key = F.concat_ws("\x01", "subject", "session_date")
    if not exceptions:
        return sessions.withColumn("montage_subject", F.col("subject"))
    pairs = F.create_map(*[F.lit(x) for (s, d), to in exceptions.items() for x in (f"{s}\x01{d}", to)])
    return sessions.withColumn("montage_subject", F.coalesce(F.element_at(pairs, key), F.col("subject")))
