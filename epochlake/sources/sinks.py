"""Sinks: partitioned parquet, the session CSV, JSON summaries."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_recordings(signals: DataFrame, events: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").partitionBy("subject").parquet(f"{path}/signals")
    events.write.mode("overwrite").partitionBy("subject").parquet(f"{path}/events")


def write_results(results: DataFrame, path: str, by: list[str] = ["subject", "session"]) -> None:  # noqa: B006
    """Results by subject and session: a rerun replaces just the partitions it has."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where none is configured and
    the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='epochlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_texts(texts: DataFrame, path: str) -> None:
    """(subject, session, value) as a text file a session, in folders as results have them."""
    texts.repartition("subject", "session").write.mode("overwrite").partitionBy("subject", "session").text(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again: cuts lineage, and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def theta_pivot(powers: DataFrame, sizes: list[int]) -> DataFrame:
    """session_number, rat_ID, electrode_number and NM_size<k> with six decimals, from (session, subject, electrode, size, power)."""
    wide = powers.groupBy(F.col("session").alias("session_number"), F.col("subject").alias("rat_ID"), F.col("electrode").alias("electrode_number")).pivot("size", sizes).agg(F.avg("power"))
    return wide.select("session_number", "rat_ID", "electrode_number", *[F.when(F.col(str(k)).isNull(), "nan").otherwise(F.format_string("%.6f", F.col(str(k)))).alias(f"NM_size{k}") for k in sizes])


def write_theta_csv(powers: DataFrame, sizes: list[int], path: str) -> None:
    theta_pivot(powers, sizes).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_montage_csv(maps: DataFrame, path: str, subject: str = "rat_id") -> None:
    """(subject, map array) as the wide CSV that readers.montage_csv reads: ch_0, ch_1, ... up to the longest map, the text
    None where a subject's is shorter or empty."""
    width = maps.agg(F.coalesce(F.max(F.size("map")), F.lit(0))).first()[0]
    channels = [F.coalesce(F.get("map", F.lit(k)).cast("string"), F.lit("None")).alias(f"ch_{k}") for k in range(width)]
    maps.select(F.col("subject").alias(subject), *channels).write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_run_summary(report: DataFrame, settings: dict, path: str) -> None:
    """One JSON row beside the results: settings, numbers of subjects, sessions, traces and failed traces, and warnings."""
    one = report.agg(F.count_distinct("subject").alias("n_subjects"), F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_traces"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("n_failed"))
    warnings = F.when(F.col("n_failed") > 0, F.array(F.lit("failed traces"))).otherwise(F.array().cast("array<string>"))
    write_json(one.select(F.lit(json.dumps(settings, default=str)).alias("settings"), "*", warnings.alias("warnings")).coalesce(1), path)


def subject_index(subjects: DataFrame) -> DataFrame:
    """(task, subject): 1-based numbers in id order, for one task per subject.  Ids are range-sorted and written; a number is
    that within the range and the count of the ranges before, which are one row each."""
    ordered = subjects.where("subject IS NOT NULL").select("subject").distinct().repartitionByRange("subject")
    ordered = staged(ordered.select("subject", F.spark_partition_id().alias("part")), "subjects")
    counts = ordered.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy("subject"))
    return ordered.withColumn("own", own).join(F.broadcast(counts.select("part", before.alias("before"))), "part").select((F.col("own") + F.col("before")).cast("int").alias("task"), "subject")
