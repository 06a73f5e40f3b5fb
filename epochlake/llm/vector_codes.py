"""Vector code compression: codebooks of vector parts, nearest entries found by vector-approximation filtering."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell: each coordinate of the entries is cut into 2**CELL_BITS cells of about as many entries each.
CELL_BITS = 4
#: Vectors compared at a time.
STEP = 512
#: Greatest magnitude of components whose squared distances fit 32 and 64 bits (in parts of 64 and 4,096); beyond, components
#: are Python integers, whose sums travel in digits of LIMB bits.
NARROW, PLAIN, LIMB = 1 << 11, 1 << 24, 30
MOST_LONG = (1 << 63) - 1


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact for every finite double: 64-bit integers, or Python integers where one is beyond PLAIN."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < PLAIN // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def entry_array(entries: list, width: int) -> np.ndarray:
    """Entries of a part as an array of 64-bit integers, or of Python integers where one is beyond PLAIN."""
    most = max((abs(v) for e in entries for v in e), default=0)
    return np.array(entries, dtype=np.int64 if most <= PLAIN else object).reshape(len(entries), width)


class Cells:
    """The entries of one part, each coordinate quantised to a cell; a cell's bounds are those of its entries' values."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, d = entries.shape
        cells = min(1 << CELL_BITS, k)
        bounds = np.linspace(0, k, cells + 1).astype(int)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.zeros((d, k), dtype=np.int64)
        self.low, self.high = (np.zeros((d, cells), dtype=entries.dtype) for _ in range(2))
        for i in range(d):
            value = entries[order[:, i], i]
            self.cell[i, order[:, i]] = np.repeat(np.arange(cells), np.diff(bounds))
            self.low[i], self.high[i] = value[bounds[:-1]], value[bounds[1:] - 1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of each row of x, the lowest index on a tie; entries compared.

        A row's tables hold, for each coordinate and cell, the least and the greatest squared difference that an entry of
        the cell can have; sums of table values over an entry's cells are bounds of its distance.  Only entries whose lower
        bound is within the least upper bound are compared exactly."""
        index, distance, compared = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=x.dtype), 0
        d = x.shape[1]
        most = max([1, *(int(np.abs(a).max()) for a in (x, self.entries) if a.size)])
        kind = object if object in (x.dtype, self.entries.dtype) else np.int32 if most <= NARROW and d <= 64 else np.int64
        low, high, entries = (a.astype(kind) for a in (self.low, self.high, self.entries))
        for s in range(0, len(x), STEP):
            q = x[s : s + STEP].astype(kind)
            least, most = (np.zeros((len(entries), len(q)), dtype=kind) for _ in range(2))
            for i in range(d):
                under, over = low[i][:, None] - q[:, i], q[:, i] - high[i][:, None]  # [cell, row]
                least += (np.maximum(np.maximum(under, over), 0) ** 2)[self.cell[i]]
                most += (np.maximum(-under, -over) ** 2)[self.cell[i]]
            row, entry = np.nonzero((least <= most.min(axis=0)).T)
            exact = ((q[row] - entries[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(q)))
            best = np.minimum.reduceat(exact, first)
            at = np.flatnonzero(exact == best[row])
            at = at[np.append(True, row[at][1:] != row[at][:-1])]  # candidates of a row are in order of index
            index[s : s + STEP], distance[s : s + STEP] = entry[at], best
            compared += len(row)
        return index, distance, compared


def _finite(e: Column) -> Column:
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _parts(column: pa.Array, size: int):
    """(rows of vectors of that length, parts [part, row, position]) of a batch."""
    at = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == size)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return at, integers(flat.reshape(len(at), PARTS, size // PARTS)).transpose(1, 0, 2)


def updated(books: list[list[list[int]]], sums: list) -> list[list[list[int]]]:
    """Codebooks with each used entry moved to the floored mean of its parts; sums: rows (part, entry, n, position, limb, s)."""
    out = [[list(e) for e in book] for book in books]
    total: dict[tuple, int] = {}
    count: dict[tuple, int] = {}
    for part, entry, n, position, limb, s in sums:
        key = (part, entry, position)
        total[key] = total.get(key, 0) + (s << (LIMB * limb))
        if limb == 0:
            count[key] = n
    for (part, entry, position), s in total.items():
        out[part][entry][position] = s // count[part, entry, position]
    return out


def _limbs(values: list[int]) -> list[list[int]]:
    """Digits of base 2**LIMB of integers, lowest first, the last with the sign: digits can be summed one by one."""
    out = [values]
    while any(abs(v) >> 62 for v in out[-1]):
        low = [v & ((1 << LIMB) - 1) for v in out[-1]]
        out = [*out[:-1], low, [v >> LIMB for v in out[-1]]]
    return out


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("position", pa.int32()), ("limb", pa.int32()), ("s", pa.decimal128(38, 0))])


def _assign_and_sum(books: list, size: int):
    cells = [Cells(entry_array(b, size // PARTS)) for b in books]

    def run(batches):
        n = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums: list = [np.zeros((len(b), size // PARTS), dtype=np.int64) for b in books]
        for b in batches:
            for k, x in enumerate(_parts(b.column("embedding"), size)[1]):
                if not len(x):
                    continue
                entry = cells[k].nearest(x)[0]
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                n[k] += np.bincount(entry, minlength=len(n[k]))
                if x.dtype == object:
                    sums[k] = sums[k].astype(object)
                sums[k][used] += np.add.reduceat(x[order], first, axis=0)
        for k in range(len(books)):
            used = np.flatnonzero(n[k])
            flat = [int(v) for v in sums[k][used].ravel()]
            entry, position = np.repeat(used, size // PARTS), np.tile(np.arange(size // PARTS), len(used))
            for i, digits in enumerate(_limbs(flat)):
                yield batch(_SUMS, np.full(len(flat), k, dtype="i4"), entry.astype("i4"), n[k][entry], position.astype("i4"), np.full(len(flat), i, dtype="i4"), pa.array(digits, pa.decimal128(38, 0)))

    return run


def fit_codebooks(rows: DataFrame, size: int, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """Codebooks [part][entry][position] of kept rows (vec_id, embedding) of one length after so many rounds over all rows.

    A round assigns every part in its task and sums there; the driver gets PARTS * ENTRIES entries' sums, whatever the
    number of rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    start = integers(np.array([r["embedding"] for r in first], dtype=np.float64).reshape(len(first), size))
    books = [[[int(v) for v in e] for e in start[:, k * size // PARTS : (k + 1) * size // PARTS]] for k in range(PARTS)]
    schema = "part int, entry int, n long, position int, limb int, s decimal(38,0)"
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_assign_and_sum(books, size), schema)
        sums = sums.groupBy("part", "entry", "position", "limb").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        books = updated(books, [(r["part"], r["entry"], r["n"], r["position"], r["limb"], int(r["s"])) for r in sums])
    return books


def compress_vectors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of rows (vec_id, embedding, label) whose vector is
    neither null nor holds null or non-finite components.

    Components x are integers floor(SCALE * x).  Vectors are cut into PARTS equal parts; a part's codebook starts as that
    part of the ENTRIES kept rows with the least vec_ids (null ids last, equal ids by components), fewer where there are
    fewer rows, and is moved to the floored means of its parts in each round (unused entries stay).  A part's code is its
    nearest entry by squared distance, the lower index on a tie; Cells filters by quantised entries before any exact
    distance.  No vector is shuffled; errors are summed by label in the tasks before they are exchanged.

    Vectors of another length than that of the least vec_id among those of a positive multiple of PARTS have null code and
    error; equal labels, nulls together, share label_error (null where none of theirs has a code).  Errors beyond a long
    are given as the greatest long; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label"))
    kept = rows.where(_finite(F.col("embedding")))
    length = F.size("embedding")
    fitting = kept.where((length > 0) & (length % PARTS == 0))
    least = fitting.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "embedding", length.alias("size"))).alias("x")).select("x.size").first()
    size = least["size"] if least and least["size"] is not None else PARTS
    books = fit_codebooks(kept.where(length == size), size, rounds)
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    label = kept.schema["label"]

    def codes(batches):
        cells = [Cells(entry_array(b, size // PARTS)) for b in books]
        for b in batches:
            at, parts = _parts(b.column("embedding"), size)
            code, error = [None] * b.num_rows, [None] * b.num_rows
            if len(at):
                found = [c.nearest(x) for c, x in zip(cells, parts, strict=True)]
                for i, r in enumerate(at.tolist()):
                    code[r] = "".join(f"{int(f[0][i]):02x}" for f in found)
                    error[r] = min(sum(int(f[1][i]) for f in found), MOST_LONG)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    out = staged(kept.mapInArrow(codes, f"vec_id long, label {label.dataType.simpleString()}, code string, error long"), "vector-codes")
    sums = out.groupBy(F.col("label").alias("s_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = sums.select("s_label", F.when(F.col("total") > MOST_LONG, F.lit(MOST_LONG)).otherwise(F.col("total").cast("long")).alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("s_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    return f"""
d{k} AS (SELECT vec_id, x.part, entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL),
a{k} AS (SELECT vec_id, part, (min({{'d': d, 'entry': entry}})).entry AS entry, min(d) AS d FROM d{k} GROUP BY ALL)"""


def _move_sql(k: int) -> str:
    return f""",
m{k} AS (SELECT x.part, a.entry, x.pos, sum(x.c) AS s, count(*)::HUGEINT AS n FROM x JOIN a{k} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
b{k + 1} AS (SELECT b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


OP11_SQL = f"""
WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v),
x AS (SELECT vec_id, (p - 1) // (n // {PARTS}) AS part, (p - 1) % (n // {PARTS}) AS pos, floor({SCALE} * CAST(y AS DOUBLE))::HUGEINT AS c FROM (SELECT vec_id, len(e) AS n, unnest(e) AS y, unnest(range(1, len(e) + 1)) AS p FROM v) u),
b0 AS (SELECT part, entry, pos, c FROM x JOIN r ON r.vec_id = x.vec_id WHERE entry < {ENTRIES}),
""" + ",".join(_round_sql(k) + (_move_sql(k) if k < ROUNDS else "") for k in range(ROUNDS + 1)) + f""",
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM b{ROUNDS}),
o AS (SELECT v.vec_id, label, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM v JOIN a{ROUNDS} a ON a.vec_id = v.vec_id GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM o, h
"""
