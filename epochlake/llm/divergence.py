"""Source divergence audit: how far the sources of each language differ in the terms they use."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch, chunks, distinct, staged, table, term_array

#: Documents of a language that hold a term at least, and ranks of terms that are reported.
LEAST_DOCS, TOP = 10, 10
#: Shares are counted in parts of SCALE, with PRIOR occurrences added to each term.
SCALE, PRIOR = 1_000_000_000, 2
#: Groups and (on average) terms of a tile.
TILE_GROUPS, TILE_TERMS = 64, 1024
#: Rows that a task holds before it sends counts on; pair matrices and groups' heaps that it holds at a time.
HELD_ROWS, HELD_MATRICES, HELD_HEAPS = 1_000_000, 64, 10_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(rows: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(rows).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([t.column(c) for c in ("lang", "source", "term", "n_sum", "docs_sum")], schema=_COUNTS)


def _count_terms(batches):
    """Counts of a task by (lang, source, term): occurrences, and documents that hold the term."""
    held, size = [], 0
    for b in batches:
        pair = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
        names = {}
        code = np.array([names.setdefault(tuple(x.values()), len(names)) for x in pair.to_pylist()], dtype=np.int64)
        lang, source = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        for i, j, data, offsets in chunks(b.column("text")):
            terms, doc = term_array(data, offsets)
            d = len(terms.dictionary)
            if not d:
                continue
            at = terms.indices.to_numpy().astype(np.int64)
            group, n = np.unique(code[i:j][doc] * d + at, return_counts=True)
            each = distinct(doc * d + at)
            _, docs = np.unique(code[i:j][each // d] * d + each % d, return_counts=True)
            held.append(batch(_COUNTS, lang.take(pa.array(group // d)), source.take(pa.array(group // d)), terms.dictionary.take(pa.array(group % d)).cast(pa.string()), n, docs))
            size += len(group)
            if size > HELD_ROWS:
                t = _counted(held)
                if t.num_rows > HELD_ROWS // 2:
                    yield from t.to_batches(max_chunksize=50_000)
                    t = t.slice(0, 0)
                held, size = t.to_batches(), t.num_rows
    if held:
        yield from _counted(held).to_batches(max_chunksize=50_000)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms that least_docs documents of their language hold, where n > 0;
    first marks one row of each (lang, term).

    Each task counts its own rows before anything is sent; one exchange, by (lang, term), serves the sums by source, the
    number of documents and the count of the language."""
    n = docs.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    n = n.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    n = n.select("*", F.sum("docs").over(of_term).alias("all_docs"), F.sum("n").over(of_term).alias("lang_n"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return n.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exact: a long division in three digits of base 1000, so that nothing
    overflows below 9e15 occurrences."""
    out, rest = np.divmod(count + PRIOR, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PARTS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


def _tiles(batches):
    """Dense group-by-term tiles: partial sums over terms of each pair of groups, and the best terms of each group."""
    matrices: dict[tuple, np.ndarray] = {}
    heaps: dict[tuple, list] = {}

    def flush():
        for (lang, a, b), m in matrices.items():
            i, j = np.nonzero(np.ones_like(m) if a != b else np.triu(np.ones_like(m), 1))
            yield batch(_PARTS, [lang] * len(i), i + a * TILE_GROUPS, j + b * TILE_GROUPS, pa.nulls(len(i), pa.string()), m[i, j])
        matrices.clear()
        for (lang, g), heap in heaps.items():
            yield batch(_PARTS, [lang] * len(heap), [g] * len(heap), pa.nulls(len(heap), pa.int64()), [h[1].text for h in heap], [h[0] for h in heap])
        heaps.clear()

    for b in batches:
        for row in b.to_pylist():
            terms, lang_n = row["terms"] or [], np.array(row["lang_n"] or [], dtype=np.int64)
            v = len(terms)
            sides = []
            for denominators, entries in ((row["totals_a"], row["entries_a"]), (row["totals_b"], row["entries_b"])):
                count = np.zeros((len(denominators), v), dtype=np.int64)
                if entries:
                    g, t, n = (np.array([e[c] for e in entries], dtype=np.int64) for c in ("g", "t", "n"))
                    count[g, t] = n
                sides.append((count, shares(count, np.array(denominators, dtype=np.int64)[:, None]) if v else count))
            (count, p), (_, q) = sides
            key = (row["lang"], row["block_a"], row["block_b"])
            if key not in matrices and (len(matrices) == HELD_MATRICES or len(heaps) > HELD_HEAPS):
                yield from flush()
            m = matrices.setdefault(key, np.zeros((len(p), len(q)), dtype=np.int64))
            for i in range(len(p)):
                m[i] += divergence(p[i], q).sum(axis=1)
            if row["block_a"] == row["block_b"] and v:
                f, own = divergence(p, shares(lang_n, np.int64(row["lang_total"]))), (count > 0) & (p > shares(lang_n, np.int64(row["lang_total"])))
                for i in np.flatnonzero(own.any(axis=1)).tolist():
                    at = np.flatnonzero(own[i])
                    heap = heaps.setdefault((row["lang"], row["block_a"] * TILE_GROUPS + i), [])
                    for k in at[np.argsort(-f[i, at], kind="stable")[:TOP]].tolist():  # terms of a tile are in order
                        item = (int(f[i, k]), _Later(terms[k]))
                        if len(heap) < TOP:
                            heapq.heappush(heap, item)
                        elif item > heap[0]:
                            heapq.heapreplace(heap, item)
    yield from flush()


class _Later:
    """A term that counts as less the later it comes in UTF-8 order."""

    __slots__ = ("text", "key")

    def __init__(self, text: str):
        self.text, self.key = text, text.encode()

    def __lt__(self, other: _Later) -> bool:
        return self.key > other.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.key == other.key


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of docs (text, lang, source).

    Part `pair`: item is each other source of the language, value the divergence of the two groups' shares summed over the
    terms kept for the language.  Part `term`: item is each of the TOP terms that the group uses more than its language
    does, value its divergence there.  Ranks are by value descending, then item.  All arithmetic is on integers.

    Counts are summed in the tasks, exchanged once and written.  A language's groups are numbered and cut into blocks of
    TILE_GROUPS, its kept terms hashed into blocks of about TILE_TERMS; a tile (language, block of terms, two blocks of
    groups) is a dense matrix of one side's shares compared with the other's by broadcasting.  Tasks sum the pair matrices
    of their tiles and merge the heaps of their groups' best terms; what they send is summed and ranked by Spark.  So no
    task holds a language, whatever share of the rows it has; rows of pairs grow with the square of a language's sources,
    as the result does.

    Null text, lang and source count as ''.  Groups without terms take part with counts of 0; a language without kept terms
    has pairs of value 0 and no terms; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    kept = staged(kept_counts(docs.select(text, lang, source), least_docs), "term-counts")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("occurrences"), F.count_if("first").alias("v"))
    names = docs.select(lang, source).distinct().withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    smoothed = lambda n: F.coalesce(F.col(n), zero) + PRIOR * F.coalesce("v", zero)
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("v", zero) / TILE_TERMS)).cast("int")
    groups = staged(names.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "g", F.floor(F.col("g") / TILE_GROUPS).cast("long").alias("block"), smoothed("n").alias("total"), smoothed("occurrences").alias("lang_total"), blocks.alias("blocks")), "term-groups")
    # terms of a block are numbered in order; the block is known from the term and the language's number of terms
    lang_blocks = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    at = kept.join(lang_blocks, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    at = at.withColumn("t", F.dense_rank().over(Window.partitionBy("lang", "tile").orderBy("term")) - 1)
    at = staged(at.select("lang", "source", "term", "n", "lang_n", "first", "tile", "t"), "term-tiles")
    vectors = at.where("first").groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("t", "term", "lang_n"))).alias("x")).select("lang", "tile", F.col("x.term").alias("terms"), F.col("x.lang_n").alias("lang_n"))
    entries = at.join(groups.select("lang", "source", "g", "block"), ["lang", "source"]).groupBy("lang", "tile", "block").agg(F.collect_list(F.struct((F.col("g") - F.col("block") * TILE_GROUPS).alias("g"), "t", "n")).alias("entries"))
    heads = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("g", "total"))).alias("x"), F.first("lang_total").alias("lang_total"), F.first("blocks").alias("blocks"))
    sides = heads.select("lang", "block", F.col("x.total").alias("totals"), "lang_total", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("tile")).join(entries, ["lang", "tile", "block"], "left")
    other = sides.select("lang", "tile", F.col("block").alias("block_b"), F.col("totals").alias("totals_b"), F.col("entries").alias("entries_b"))
    own = sides.select("lang", "tile", F.col("block").alias("block_a"), F.col("totals").alias("totals_a"), F.col("entries").alias("entries_a"), "lang_total")
    tiles = own.join(other, ["lang", "tile"]).where("block_a <= block_b").join(vectors, ["lang", "tile"], "left")
    parts = staged(tiles.mapInArrow(_tiles, "lang string, a long, b long, term string, value long"), "divergence-parts")
    name = groups.select("lang", F.col("g").alias("a"), "source")
    item = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"))
    pairs = parts.where("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(name, ["lang", "a"]).join(item, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = parts.where("term IS NOT NULL").join(name, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
l AS (SELECT lang, sum(n) AS total, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * v) AS q
      FROM s JOIN l ON l.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
