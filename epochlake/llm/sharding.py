"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import shared_dir, slots, staged, table

SHARDS = 24
SEED = 20_240_101
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 256
#: Text a task should hold where buckets are smaller, and the least number of tasks.
TASK_BYTES = 16 << 20
LEAST_TASKS = 32


#: Beyond so many times the size of a bucket, copies of one row lie in it: rows are then numbered and spread by number too.
MOST_HELD = 4


def _light() -> list[Column]:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]


def light_rows(docs: DataFrame) -> DataFrame:
    return docs.select(*_light())


def _bucket_count(rows: DataFrame, bucket_bytes: int) -> tuple[int, int]:
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return total, max(LEAST_BUCKETS, -(-total // bucket_bytes))


def _bucket(buckets: int, seed: int, *more: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "text_crc32", "size", *more), F.lit(buckets))


def _held(rows: DataFrame, buckets: int, seed: int, *more: str) -> tuple[np.ndarray, int]:
    """(rows of each bucket, bytes of the largest)."""
    got = rows.groupBy(_bucket(buckets, seed, *more).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).toArrow()
    n = np.zeros(buckets, dtype=np.int64)
    n[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return n, max(got.column("bytes").to_pylist(), default=0)


def _permutation(seed: int, bucket: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shuffle_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The places write_shards gives, without the records: add shard and slot to rows (doc_id, size, text_crc32); law `rows`: counts of shards are at most one apart.

    Pass one scatters rows into memory-sized buckets by a seeded hash of doc_id and text checksum (so copies of a text
    spread too).  Pass two sorts each bucket's light rows by their values, so that a recomputed task sees one order,
    and permutes them by Fisher-Yates with a generator seeded by (seed, bucket).  The place of a row in the whole is
    its bucket's start, a prefix sum over bucket counts, plus its place in the bucket; shards are equal runs of places.

    Null texts have size 8; null doc_ids and equal rows are ordinary rows; an empty table gives no rows.
    """
    _, buckets = _bucket_count(rows, bucket_bytes)
    dealt = rows.withColumn("bucket", _bucket(buckets, seed))

    def permute(key, t):
        t = t.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        place = _permutation(seed, key[0].as_py(), t.num_rows)
        return t.append_column("place", pa.array(place, pa.int64()))

    placed = dealt.groupBy("bucket").applyInArrow(permute, "doc_id long, size long, text_crc32 long, bucket long, place long")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket")
    starts = counts.select(F.col("bucket").alias("b"), (F.sum("n").over(order) - F.col("n")).alias("start"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_rows"))
    at = F.col("start") + F.col("place")
    out = placed.join(starts, F.col("bucket") == F.col("b")).withColumn("at", at)
    out = out.withColumn("shard", F.expr(f"({shards} * (at + 1) - 1) DIV all_rows").cast("int"))
    return out.withColumn("slot", F.col("at") - F.expr("(CAST(shard AS long) * all_rows) DIV " + str(shards))).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, rows_per_file: int = 1_000_000, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write whole records to path/shard=k/, rows of a shard by slot over files of rows_per_file; returns their placement
    (doc_id, size, text_crc32, shard, slot) as read from the files.

    Pass one scatters the records with their texts into the buckets of shuffle_shards; a task receives neighbouring
    buckets, so its places are one run.  Pass two permutes each bucket: its records arrive sorted by their values and
    stream through with their places, so no bucket is held in memory beyond the engine's own sorts, which can spill.
    Only the rows of each bucket are counted before, from light rows; the counts (one a bucket) reach the driver.  Where
    very many copies of one row would overfill a bucket, rows are numbered in a copy and dealt by number too.

    Null texts have size 8 and stay null; null doc_ids and repeated rows are ordinary records (equal ones change places
    without effect, so a recomputed task writes the same); columns named shard or slot are left out of the files, all others
    are kept; an empty table writes none.
    """
    light = staged(light_rows(docs), "shard-rows")
    total, buckets = _bucket_count(light, bucket_bytes)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    dealt, more = docs.select(row, *_light()), []
    n, largest = _held(light, buckets, seed)
    if largest > MOST_HELD * bucket_bytes:
        # the numbers are written, so that a recomputed task deals each copy to the bucket it was counted in
        dealt, more = staged(dealt.withColumn("number", F.monotonically_increasing_id()), "shard-numbered"), ["number"]
        n, _ = _held(dealt, buckets, seed, *more)
    start, rows = np.cumsum(n) - n, int(n.sum())
    tasks = int(min(buckets, max(LEAST_TASKS, -(-total // TASK_BYTES))))
    dealt = dealt.withColumn("bucket", _bucket(buckets, seed, *more))
    dealt = dealt.repartitionById(tasks, F.expr(f"CAST(bucket * {tasks} DIV {buckets} AS int)"))
    dealt = dealt.sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), "text_crc32", "size").select("row", "bucket")

    def place(batches):
        bucket, seen, order = -1, 0, np.zeros(0, dtype=np.int64)
        for b in batches:
            values, bounds = slots(b.column("bucket").to_numpy())
            at = np.zeros(b.num_rows, dtype=np.int64)
            for value, lo, hi in zip(values.tolist(), bounds[:-1], bounds[1:], strict=False):
                if value != bucket:
                    bucket, seen, order = value, 0, _permutation(seed, value, int(n[value]))
                at[lo:hi] = start[value] + order[seen : seen + hi - lo]
                seen += hi - lo
            shard = (shards * (at + 1) - 1) // max(rows, 1)
            columns = [b.column("row"), pa.array(shard, pa.int32()), pa.array(at - shard * rows // shards, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "shard", "slot"])

    places = [StructField("shard", IntegerType()), StructField("slot", LongType())]
    out = dealt.mapInArrow(place, StructType([dealt.schema["row"], *places])).sortWithinPartitions("shard", "slot")
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(StructType([*[docs.schema[c] for c in own], *places])).parquet(path)
    return back.select(*_light(), "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_shards(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
