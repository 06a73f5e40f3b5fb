"""Exact order statistics of distributed values: no task holds more than a bounded part of a group.

Ranks are narrowed over rounds.  In each round every group's values are counted in bins between edges taken from a mergeable
sketch; a wanted rank lies in one bin, and only that bin's values are looked at in the next round.  Bins are counted exactly,
so the sketch decides how fast ranks are narrowed, never which value is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged

#: Values that one task may sort for a rank, edges of a round, and accuracy of the sketch that gives them.
SORTED, EDGES, ACCURACY = 100_000, 32, 2_000
#: Rows of intervals up to which they are broadcast.
MOST_SENT = 100_000


def _positions(n: Column, at: list[float]) -> Column:
    """The one or two ranks (from 0) that each quantile of n values lies between."""
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor(q * (n - 1)), F.ceil(q * (n - 1))) for q in map(F.lit, at)])))


def ranked_values(values: DataFrame, keys: list[str], value: str, at: list[float], limit: int = SORTED) -> DataFrame:
    """(keys, n, rank, v): the values at the ranks that the quantiles `at` of each group need; n is the group's count of
    values other than null.  NaN counts as the greatest value."""
    # keys under names of their own, so that none clashes with those used here; without keys, one for all
    v = values.where(F.col(value).isNotNull()).select(F.lit(0).alias("key_"), *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    own = ["key_", *[f"key_{i}" for i in range(len(keys))]]
    return _narrowed(v, own, at, limit).select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], "n", "rank", "v")


def _narrowed(v: DataFrame, keys: list[str], at: list[float], limit: int) -> DataFrame:
    sizes = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    wanted = sizes.select(*keys, "n", F.explode(_positions(F.col("n"), at)).alias("rank"), F.lit(0).cast("long").alias("base"), "low", "high", F.col("n").alias("size"))
    state = staged(wanted, "ranks")
    within = [F.col(k).eqNullSafe(F.col(f"i_{k}")) for k in keys]
    # a value is in one interval at most: those of a group are whole bins
    interval = [*[f"i_{k}" for k in keys], "low", "high"]
    while True:
        open_ = state.where(~F.col("low").eqNullSafe(F.col("high")))
        most, rows = open_.agg(F.max("size"), F.count(F.lit(1))).first()
        if most is None:
            return state.select(*keys, "n", "rank", F.col("low").alias("v"))
        spans = open_.select(*[F.col(k).alias(f"i_{k}") for k in keys], "low", "high").distinct()
        spans = F.broadcast(spans) if rows <= MOST_SENT else spans
        held = v.join(spans, [*within, F.col("v").between(F.col("low"), F.col("high"))]).select(*interval, "v")
        ranks = open_.select(*[F.col(k).alias(f"i_{k}") for k in keys], "low", "high", "n", "rank", "base")
        if most <= limit:
            own = F.row_number().over(Window.partitionBy(*interval).orderBy("v")) - 1
            held = held.withColumn("own", own)
            found = _same(held, ranks, interval).where(F.col("own") + F.col("base") == F.col("rank"))
            found = found.select(*[F.col(f"i_{k}").alias(k) for k in keys], "n", "rank", "v")
            return state.where(F.col("low").eqNullSafe(F.col("high"))).select(*keys, "n", "rank", F.col("low").alias("v")).unionByName(found)
        cuts = [F.lit(i / (EDGES + 1)) for i in range(1, EDGES + 1)]
        edges = held.groupBy(*interval).agg(F.array_distinct(F.percentile_approx(F.when(~F.isnan("v"), F.col("v")), F.array(*cuts), ACCURACY)).alias("edges"))
        edges = staged(edges, "edges")  # a sketch worked out again, after a loss, may give other edges to some of the tasks
        # bins between edges, and one for each edge itself, so that a frequent value is found at once
        below = F.size(F.filter("edges", lambda e: e < F.col("v")))
        number = F.when(F.col("edges").isNull(), 0).otherwise(2 * below + F.array_contains("edges", F.col("v")).cast("int"))
        binned = _same(held, edges, interval).groupBy(*interval, number.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("b_low"), F.max("v").alias("b_high"))
        before = F.sum("c").over(Window.partitionBy(*interval).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        binned = binned.withColumn("before", F.coalesce(before, F.lit(0)))
        hit = F.col("rank") - F.col("base")
        narrowed = _same(binned, ranks, interval).where((hit >= F.col("before")) & (hit < F.col("before") + F.col("c")))
        narrowed = narrowed.select(*[F.col(f"i_{k}").alias(k) for k in keys], "n", "rank", (F.col("base") + F.col("before")).alias("base"), F.col("b_low").alias("low"), F.col("b_high").alias("high"), F.col("c").alias("size"))
        state = staged(state.where(F.col("low").eqNullSafe(F.col("high"))).unionByName(narrowed), "ranks")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """a and b joined where the columns agree, nulls and NaNs included; b's copies are dropped."""
    other = b.select(*[F.col(c).alias(f"o_{c}") if c in columns else F.col(c) for c in b.columns])
    return a.join(other, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in columns]).drop(*[f"o_{c}" for c in columns])


def quantiles(values: DataFrame, keys: list[str], value: str, at: list[float], limit: int = SORTED) -> DataFrame:
    """(keys, n, q array<double>): the quantiles `at` of each group's values, between neighbours in proportion; nulls are left
    out, groups without values are absent.  Each round reads the values again."""
    found = ranked_values(values.select(*[F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)], F.col(value).alias("v")), [f"of_{i}" for i in range(len(keys))], "v", at, limit)
    names, keys = keys, [f"of_{i}" for i in range(len(keys))]
    each = found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v"))  # two ranks a quantile
    position = [F.lit(q) * (F.col("n") - 1) for q in at]
    low, high = (lambda p: F.element_at("v", F.floor(p))), (lambda p: F.element_at("v", F.ceil(p)))
    return each.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "n", F.array(*[F.when(low(p) == high(p), low(p)).otherwise(low(p) + (high(p) - low(p)) * (p - F.floor(p))) for p in position]).alias("q"))


def numbered(df: DataFrame, keys: list[str], order: list[str], limit: int = SORTED) -> DataFrame:
    """df with i, the 0-based number of each row within its keys in the given order (rows that are equal in all of it in any),
    and n, the number of rows.  Where a group has more than limit rows, as a count of the keys tells first, groups are cut at
    edges of their first order column; rows are numbered within a cut, after the counts of the cuts before."""
    if df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty():
        small = Window.partitionBy(*keys)
        return df.select("*", (F.row_number().over(small.orderBy(*order)) - 1).alias("i"), F.count(F.lit(1)).over(small).alias("n"))
    first = F.col(order[0]).cast("double")
    cuts = F.array(*[F.lit(i / (EDGES + 1)) for i in range(1, EDGES + 1)])
    edges = df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.percentile_approx(first, cuts, ACCURACY)).alias("edges"))
    # written, as a sketch may come out otherwise when it is worked out again, and all rows must be cut alike
    edges = staged(edges.withColumn("edges", F.when(F.col("n") > limit, F.col("edges"))), "edges")
    # nulls come first in an ascending order
    cut = F.when(F.col("edges").isNull(), 0).when(first.isNull(), -1).otherwise(2 * F.size(F.filter("edges", lambda e: e < first)) + F.array_contains("edges", first).cast("int"))
    b = df.join(edges, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]).withColumn("cut", cut)
    counts = b.groupBy(*[f"k_{k}" for k in keys], "cut").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(*[f"k_{k}" for k in keys]).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(f"k_{k}").alias(f"c_{k}") for k in keys], F.col("cut").alias("c_cut"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*[f"k_{k}" for k in keys], "cut").orderBy(*order)) - 1
    out = b.withColumn("own", own).join(counts, [*[F.col(f"k_{k}").eqNullSafe(F.col(f"c_{k}")) for k in keys], F.col("cut") == F.col("c_cut")])
    return out.select(*df.columns, (F.col("own") + F.col("before")).alias("i"), "n")


def size_class(i: Column, n: Column, classes: int) -> Column:
    """Class from 1 on of number i of n in order: classes differ by one row at most, the larger ones first."""
    small, more = F.floor(n / classes), n % classes
    return F.when(i < more * (small + 1), F.floor(i / (small + 1)) + 1).otherwise(F.floor((i - more) / small) + 1).cast("int")
