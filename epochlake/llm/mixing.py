"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ROW, plain_rows, staged, table, with_row_keys

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Leading hex digits of the random key that name a range of keys: 16**3 equal ranges within each source.
RANGE_DIGITS = 3
_GAP = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null and empty have none."""
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, _GAP + "+"))
    ends = F.rlike(text, F.lit("^" + _GAP)).cast("int") + F.rlike(text, F.lit(_GAP + r"\z")).cast("int")
    return F.when(text == "", 0).otherwise(parts - ends).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point (null last) and share
    `share` of all words; a target stops at `most` times its source's size and the excess is reshared by weight.

    The reshared fixpoint is target = min(most * size, level * weight) for one level, which is the greatest of
    (total - capped before) / (weights from here) over the sources ordered by capacity per weight.
    One row per source: the window over all of them is small whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("ahead", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("ahead")).over(everything))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = SEED, row: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, source, text): size, source_size, target and taken, the words the mix takes of it.

    Each row has a hash-random key of the seed, its doc_id and its text.  Within a source, rows are sorted by key in
    16**RANGE_DIGITS key ranges of equal width, each of them a window partition of its own; a range's start in the
    source's prefix sum comes from the summed sizes of the ranges before it, so no task sorts or scans a whole source,
    hot or not.  A target of e sizes and a rest takes e whole epochs and cuts the next one at the rest, to the word.

    The texts are scanned once: keys and sizes go to a table in the shared folder.  Rows equal in doc_id and text have
    equal keys and sizes, and it does not matter which of them is cut; given `row`, a column of unique keys, it decides and
    is returned too.  Null texts have size 0 and nothing is taken of them; null sources form a source; an empty
    table gives no rows; other columns are not read.
    """
    more = [row] if row else []
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    light = staged(docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"), key.alias("key"), *more), "mix-sizes")
    light = light.withColumn("key_range", F.substring("key", 1, RANGE_DIGITS))
    ranges = light.groupBy("source", "key_range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes)
    starts = ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("key_range").alias("r"), "range_start", "source_size", "target")
    within = Window.partitionBy("source", "key_range").orderBy("key", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = light.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("key_range") == F.col("r")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("in_range")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of docs as the mix takes them, columns unchanged: a text taken e times over stands e times, and one
    cut by its source's budget is shortened to the words taken of it (joined by one space).

    Every row is taken by itself, whatever its doc_id: null and repeated ids, repeated rows and clashing columns are rows
    like any other, so the words of a source come to its budget exactly.  Texts without words are never taken; an empty
    table gives no rows.
    """
    keyed = with_row_keys(docs)
    took = mix(keyed.select("row.doc_id", "row.source", "row.text", ROW), seed, ROW).where("taken > 0").select(F.col(ROW).alias("t_row"), "size", "taken")
    d = keyed.join(took, F.col(ROW) == F.col("t_row")).select("row", "size", "taken")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    words = F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(left, F.lit(1))), " ")
    new = {"text": F.when(left >= F.col("size"), F.col("row.text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(left >= F.col("size"), F.col("row.n_chars")).otherwise(F.length(cut)).cast(docs.schema["n_chars"].dataType)
    return plain_rows(d, docs.columns, **new)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
      (sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS ahead,
      (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, max((total - before) / ahead) OVER () AS level FROM c),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target, CAST(floor(least(2.0::DOUBLE * source_size, level * weight) + 0.5) AS BIGINT) AS budget FROM l),
p AS (SELECT doc_id, size, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
      CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken FROM p
"""
