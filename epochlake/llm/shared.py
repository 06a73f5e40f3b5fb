"""Shared folder, table access and byte-level text kernels of the training-data operators.

The kernels work on the UTF-8 buffer of an Arrow string column, so that no Python
object is made per word.  A word is a maximal run of bytes other than 0x20 and
0x09-0x0D; as these never occur inside a multi-byte character, byte words and
character words agree.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="epochlake-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW = "row_key"


def with_row_keys(docs: DataFrame) -> DataFrame:
    """docs as (ROW long, row struct of all columns), a key of its own for each row and the same one in every scan.

    Where doc_ids are unique and never null, as a light pass over them finds, the key is the doc_id.  Otherwise rows are
    numbered once, in a copy in the shared folder."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counts = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if counts.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias(ROW), row)
    return staged(docs.select(F.monotonically_increasing_id().alias(ROW), row), "numbered-rows")


def plain_rows(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of df's struct row, some of them replaced."""
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20, least: int = 64, most: int = 1 << 31) -> int:
    """Buckets so that each holds about per_bucket bytes of input, whatever the size of the input.

    Catalyst knows the size of files; for other inputs the bytes of column text are summed once."""
    size = scan_bytes(df)
    if size >= 1 << 55:
        size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(least, min(most, -(-size // per_bucket)))


# -- hashing ------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(k) for k in (30, 27, 31)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (public splitmix64 finalizer)."""
    x = x ^ (x >> _S[0])
    x = x * _M1
    x ^= x >> _S[1]
    x *= _M2
    x ^= x >> _S[2]
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_COEF = {k: _stream(3 + k, 64) | np.uint64(1) for k in range(4)}
#: Spans longer than this are hashed by a digest.
SHORT_SPAN = 64
_PLACE = _stream(1, SHORT_SPAN // 8)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside terms: a term is a maximal run of characters other than U+0000-U+0040, U+005B-U+0060 and U+007B-U+007F.
NO_TERM = np.zeros(256, dtype=bool)
NO_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: the sum of the scrambled 8-byte pieces, each under a key of its place and scrambled
    with the length; of spans over SHORT_SPAN bytes a BLAKE2b digest.  No prefix sums or powers of one base are involved,
    so repetitive texts (Thue-Morse words, say) have no structure in common with it."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    at = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each position
    size = ends - starts

    def piece(begin, left):
        over = (8 - np.clip(left, 0, 8)).astype(np.uint64) << np.uint64(3)
        return at[begin] << over >> over

    total = mix(piece(starts, size) ^ _PLACE[0])
    k, todo = 1, np.flatnonzero((size > 8) & (size <= SHORT_SPAN))
    while len(todo):
        total[todo] += mix(piece(starts[todo] + 8 * k, size[todo] - 8 * k) ^ _PLACE[k])
        k, todo = k + 1, todo[size[todo] > 8 * (k + 1)]
    out = mix(total + size.astype(np.uint64) * _COEF[0][63])
    long = np.flatnonzero(size > SHORT_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digests), dtype="<u8")
    return out


def window_hash(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of `width` words of the array (document borders are the caller's matter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += words[k : k + n] * _COEF[salt][k]
    return mix(out)


class Words:
    """Word spans of some whole texts: starts/ends (bytes), doc (text of each word), first (word offsets by text).  gaps: the
    bytes that separate words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = SPACE):
        self.data = data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        gap = gaps[data]
        border = np.zeros(n + 1, dtype=bool)
        border[offsets] = True
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        self.starts = np.flatnonzero(~gap & (before | border[:-1]))
        self.ends = np.flatnonzero(~gap & (after | border[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms of some whole texts, A-Z lower-cased, as a dictionary array; text of each)."""
    w = Words(data, offsets, lower=True, gaps=NO_TERM)
    chars = w.data[~NO_TERM[w.data]]
    ends = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.cumsum(w.ends - w.starts, out=ends[1:])
    terms = pa.LargeStringArray.from_buffers(len(w.starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars)))
    return terms.dictionary_encode(), w.doc


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, rows: int = 60_000):
    """Slices (first row, end row, bytes, offsets) of whole texts, about CHUNK_BYTES each (a longer text alone)."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def slots(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the bounds of their runs."""
    if not len(order_key):
        return order_key, np.zeros(1, dtype=np.int64)
    cut = np.flatnonzero(order_key[1:] != order_key[:-1]) + 1
    bounds = np.concatenate([[0], cut, [len(order_key)]])
    return order_key[bounds[:-1]], bounds


# -- exchanges of packed arrays ------------------------------------------------


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_small(values: np.ndarray) -> bytes:
    """Values at the least common width (8 bytes if any is negative), which is the first byte."""
    width = 1 if not len(values) else 8 if values.min() < 0 else max((int(values.max()).bit_length() + 7) // 8, 1)
    return bytes([width]) + pack(values, width)


def unpack_small(raw: bytes) -> np.ndarray:
    return unpack(raw[1:], raw[0])


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def by_key(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(rows of one key as lists by column) yields record batches; keys are hash-partitioned and streamed in order.

    Unlike a grouped-map call this costs no Arrow batch per key, so it suits many small groups too.
    """

    def stream(batches):
        held: list | None = None
        key = None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in b.schema.names]
            at = [b.schema.names.index(k) for k in keys]
            for row in zip(*cols, strict=True):
                k = tuple(row[i] for i in at)
                if k != key:
                    if held:
                        yield from run(key, held)
                    held, key = [], k
                held.append(row)
        if held:
            yield from run(key, held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node reachable from each of n nodes by the links a[i] - b[i], in memory."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# -- connected components ------------------------------------------------------


def _are_stars(links: DataFrame) -> bool:
    """Whether no node of links (a, b), a > b, has two smaller neighbours, or both a smaller and a larger one: every b is then
    the least node of its component."""
    up = links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    down = links.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    n = up.unionByName(down).groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return n.where("smaller > 1 OR smaller > 0 AND larger > 0").isEmpty()


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds (public map-reduce algorithm): each is a pre-aggregated minimum per
    node and a join back, so a node with very many links is neither gathered nor expanded, and the number of rounds
    grows with the logarithm of the longest chain.  Each round is a table in the shared folder.  Rounds go on until every
    component is a star around its least node, which is tested exactly, node by node; where most_rounds is given and does
    not suffice, an error is raised.
    """
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = staged(e, "links")
    for done in count():
        if _are_stars(e):
            break
        if done == most_rounds:
            raise RuntimeError(f"components: not all links lead to the least node after {most_rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = staged(e, "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
