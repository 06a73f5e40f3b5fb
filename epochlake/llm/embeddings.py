"""Embedding near-dedup by a subspace pigeonhole join."""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, by_key, components, mix, roots, staged, table

COSINE = 0.95
BLOCK_DIMS = 8
SEED = 7
#: Cuts of a block's grid at least, whatever the number of vectors; more are made only while a cell would hold more home
#: vectors than a task (SIDE), at most MOST_CUTS.
LEAST_CUTS, MOST_CUTS = 3, 16
#: Most components of the vectors on one side of a task, pairs compared at a time, and bytes of vectors dealt at a time.
SIDE, PAIRS, DEALT_BYTES = 1 << 21, 1 << 22, 16 << 20
#: Sub-cells to the root of a block's budget.
FINE = 1
#: Added to squared distances before they are compared with a budget: more than rounding can take from them.
SLACK = 1e-9


@cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of finite vectors other than zero; scaled by the largest component first, so that no square overflows or
    vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Subspaces:
    """A seeded rotation of unit vectors of one length, its blocks of dimensions, their squared-distance budgets and grids.

    The grid of a block has so many cuts: each dimension is first cut in two at its mean, then in four at the quartiles of
    a normal distribution of its spread.
    """

    def __init__(self, mean: np.ndarray, spread: np.ndarray, cuts: int, cosine: float = COSINE):
        self.mean, self.d = mean, len(mean)
        self.blocks = [(a, min(a + BLOCK_DIMS, self.d)) for a in range(0, self.d, BLOCK_DIMS)]
        total = 2 * (1 - cosine)
        self.budget = [total * (b - a) / self.d + SLACK for a, b in self.blocks]
        self.cosine = cosine
        self.edges = []
        for a, b in self.blocks:
            bits = [max(0, min(2, (cuts - i + b - a - 1) // (b - a))) for i in range(b - a)]
            self.edges.append([mean[a + i] + spread[a + i] * np.array([NormalDist().inv_cdf(q / (1 << k)) for q in range(1, 1 << k)]) for i, k in enumerate(bits)])

    def rotate(self, u: np.ndarray) -> np.ndarray:
        return u @ rotation(self.d)

    def cells(self, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each vector, vector, cell): also all other cells within the block's budget of each vector."""
        a, n = self.blocks[k][0], len(z)
        home, at, cell, used = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n)
        for i, edges in enumerate(self.edges[k]):
            m = len(edges) + 1
            if m == 1:
                continue
            x = z[:, a + i]
            low, high = np.append(-np.inf, edges), np.append(edges, np.inf)
            gap = np.maximum(np.maximum(low - x[:, None], x[:, None] - high), 0) ** 2
            home = home * m + np.searchsorted(edges, x)
            total = used[:, None] + gap[at]
            row, part = np.nonzero(total <= self.budget[k])
            at, cell, used = at[row], cell[row] * m + part, total[row, part]
        away = cell != home[at]
        return home, at[away], cell[away]

    def hosted(self, home: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Of two cells, whether the second hosts their pairs: a coin for each two cells, so that each pair meets once."""
        low, high = np.minimum(home, cell).astype(np.uint64), np.maximum(home, cell).astype(np.uint64)
        coin = (mix(low * np.uint64(0x9E3779B97F4A7C15) + high) & np.uint64(1)).astype(bool)
        return (cell > home) == coin


class Nested:
    """Points of one block in sub-cells nested over its dimensions: each dimension is cut at multiples of the root of the
    budget over FINE, and only occupied sub-cells exist.  A level's table has, for each sub-cell and each place in the next
    dimension, the sub-cell there (-1: none), with empty places at both ends."""

    def __init__(self, y: np.ndarray, budget: float):
        self.width = np.sqrt(budget) * (1 + 1e-6) / FINE
        self.budget = budget / self.width**2  # in sub-cells, as all gaps are
        cell = np.floor(y / self.width).astype(np.int64)
        self.low = cell.min(axis=0)
        cell -= self.low
        self.span = cell.max(axis=0) + 1
        self.order = np.lexsort(cell.T[::-1])
        cell = cell[self.order]
        node, first = np.zeros(len(y), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.tables = []
        for k in range(cell.shape[1]):
            wide = self.span[k] + 4 * FINE + 2
            key = node * wide + cell[:, k] + 2 * FINE + 1
            new = np.append(True, key[1:] != key[:-1])
            table = np.full(len(first) * wide, -1, dtype=np.int32)
            table[key[new]] = np.arange(new.sum())
            self.tables.append(table)
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.first = np.append(first, len(y))

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, point): all pairs whose squared distance keeps the budget, and some others.  Level by level, a row goes
        on to the sub-cells within FINE of its own, as long as its gaps to them keep the budget together."""
        at, node, used = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        place = x / self.width
        own = np.floor(place)
        part = np.ascontiguousarray((place - own).T)
        own = np.ascontiguousarray(np.clip(own - self.low, -FINE - 1, self.span + FINE).T).astype(np.int64) + 2 * FINE + 1
        for k, table in enumerate(self.tables):
            begin, inside = node * np.int64(self.span[k] + 4 * FINE + 2) + own[k].take(at), part[k].take(at)
            found = []
            for off in range(-FINE, FINE + 1):
                child = table[begin + off]
                total = used if off == 0 else used + (off - inside if off > 0 else inside - off - 1) ** 2
                keep = np.flatnonzero((child >= 0) & (total <= self.budget))
                found.append((at[keep], child[keep], total[keep]))
            at, node, used = (np.concatenate(c) for c in zip(*found, strict=True))
        count = self.first[node + 1] - self.first[node]
        return np.repeat(at, count), self.order[np.repeat(self.first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _matrix(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """The vectors of the rows, all of length d."""
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def _by_length(column: pa.Array):
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        yield int(d), np.flatnonzero(size == d)


def valid_vectors(rows: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(e, lambda x: x != 0))


def _cell_join(spaces: dict[int, Subspaces], kind: str):
    """Of home and other vectors of one grid cell: link counts, and links that connect them."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(key, rows):
        space, k = spaces[key[0]], key[1]
        lo, hi = space.blocks[k]
        sides = []
        for role in (1, 2):
            mine = [r[5:] for r in rows if r[4] == role]
            ids, n = (np.concatenate([np.frombuffer(r[c], dtype="<i8") for r in mine]) if mine else np.zeros(0, dtype="<i8") for c in (0, 1))
            u = unit(np.concatenate([np.frombuffer(r[2], dtype=kind).reshape(-1, space.d) for r in mine])) if mine else np.zeros((0, space.d))
            sides.append((ids, n, u, space.rotate(u)))
        (xi, xn, xu, xz), other = sides
        own = key[3] in (OWN, OWN_AND_FIRST)
        if own:  # home vectors among themselves, each pair once: the later of the two as the other side
            yi, yn, yu, yz = (np.concatenate(c) for c in zip(sides[0], other, strict=True))
        else:
            yi, yn, yu, yz = other
        if not len(xi) or not len(yi):
            return
        nodes, at = np.unique(np.concatenate([xi, yi]), return_inverse=True)
        xat, yat = at[: len(xi)], at[len(xi) :]
        root = np.arange(len(nodes))
        xb, yb = np.ascontiguousarray(xz[:, lo:hi]), np.ascontiguousarray(yz[:, lo:hi])
        nested = Nested(yb, space.budget[k])
        xc, yc = np.zeros(len(xi), dtype=np.int64), np.zeros(len(yi), dtype=np.int64)
        step = min(max(PAIRS // len(yi), 1), 512)
        for s in range(0, len(xi), step):
            i, j = nested.pairs(xb[s : s + step])
            i += s
            if own:
                later = j > i
                i, j = i[later], j[later]
            for c in range(0, len(i), 1 << 16):
                p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                delta = xb.take(p, axis=0) - yb.take(q, axis=0)
                near = np.einsum("ij,ij->i", delta, delta) <= space.budget[k]
                p, q = p[near], q[near]
                ok = np.einsum("ij,ij->i", xu[p], yu[q]) >= space.cosine
                p, q = p[ok], q[ok]
                delta, first = (xz[p] - yz[q]) ** 2, np.ones(len(p), dtype=bool)
                for b in range(k):  # a pair counts in the first block whose budget it keeps
                    first &= delta[:, slice(*space.blocks[b])].sum(axis=1) > space.budget[b]
                p, q = p[first], q[first]
                np.add.at(xc, p, yn[q])
                np.add.at(yc, q, xn[p])
                # only links between groups not yet connected are held: at most one a vector
                a, b = root[xat[p]], root[yat[q]]
                new = a != b
                if new.any():
                    root = roots(len(nodes), np.concatenate([np.arange(len(nodes)), a[new]]), np.concatenate([root, b[new]]))
        count = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(count, xat, xc)
        np.add.at(count, yat, yc)
        some, led = count > 0, root != np.arange(len(nodes))
        if some.any():
            yield batch(schema, np.repeat(np.array([0, 1], dtype="i4"), [some.sum(), led.sum()]), np.concatenate([nodes[some], nodes[led]]), np.concatenate([count[some], nodes[root[led]]]))

    return run


#: Others of a task: the home part itself (also with the first part of visitors), an earlier home part, or (from VISITS on)
#: a part of the visitors.
OWN, OWN_AND_FIRST, EARLIER, VISITS = -1, 0, -2, 1
_DEALT = "d int, block int, cell long, other long, role int, ids binary, n binary, vectors binary"
_DEALT_ARROW = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("other", pa.int64()), ("role", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("vectors", pa.binary())])


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding).

    Equal vectors are counted into one representative first, so any number of copies costs one.  Unit vectors at cosine c
    have squared distance 2 - 2c; they are rotated and split into blocks of BLOCK_DIMS dimensions, and two of
    them keep the proportional budget in one block at least.  In each block a grid of the same few cuts for tables of any
    usual size (more only where a cell would not fit a task) splits the vectors into home cells; of two cells within the
    budget of each other one hosts the other's vectors, so a pair meets once a block and the vectors that move grow with
    the table, not with its square.  In a cell: block distance, then the exact cosine in double precision; a pair counts in
    the first block whose budget it keeps.  Home vectors and visitors are both cut into parts of at most SIDE components,
    each part of the one meeting each part of the other in a task of its own, so a task's memory is bounded.  Only cell
    counts (at most blocks * 2**MOST_CUTS a length) and sums by dimension reach the driver.

    Vectors of each length are compared among themselves (one grid a length; lengths are few).  Vectors that are null,
    zero, or hold null or non-finite components link with nothing.  Rows with a null vec_id take no part; repeated rows are
    each linked with their copies; an empty table gives no rows; other columns are not read.
    """
    double = "array<double>" in dict(rows.dtypes)["embedding"]
    kind = "<f8" if double else "<f4"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    good = valid_vectors(rows.where("vec_id IS NOT NULL"))
    classes = staged(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    spaces = grids(classes, cosine)

    def homes(batches):
        schema = pa.schema([("d", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("n", pa.int64()), ("visits", pa.int64())])
        for b in batches:
            for d, at in _by_length(b.column("embedding")):
                space = spaces[d]
                z = space.rotate(unit(_matrix(b.column("embedding"), at, d)))
                for k in range(len(space.blocks)):
                    home, of, cell = space.cells(z, k)
                    cell = cell[space.hosted(home[of], cell)]
                    names, where = np.unique(np.concatenate([home, cell]), return_inverse=True)
                    n = np.bincount(where[: len(home)], minlength=len(names))
                    visits = np.bincount(where[len(home) :], minlength=len(names))
                    yield batch(schema, np.full(len(names), d, dtype="i4"), np.full(len(names), k, dtype="i4"), names, n, visits)

    held = classes.select("embedding").mapInArrow(homes, "d int, block int, cell long, n long, visits long").groupBy("d", "block", "cell").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits")).where("n > 0").collect()
    side = lambda d: max(SIDE // d, 1)
    parts = {(r["d"], r["block"], r["cell"]): (-(-r["n"] // side(r["d"])), -(-r["visits"] // side(r["d"]))) for r in held}

    def deal(batches):
        for b in batches:
            all_ids, all_n = b.column("rep").to_numpy(), b.column("n").to_numpy()
            out, size = [], 0
            for d, at in _by_length(b.column("embedding")):
                space, x = spaces[d], _matrix(b.column("embedding"), at, d).astype(kind)
                ids, n = all_ids[at], all_n[at]
                z = space.rotate(unit(x))
                mixed = mix(ids.astype(np.uint64))
                for k in range(len(space.blocks)):
                    home, of, cell = space.cells(z, k)
                    mine = space.hosted(home[of], cell)
                    of, cell = of[mine], cell[mine]
                    order = np.lexsort((of, cell))
                    of, cell = of[order], cell[order]
                    by_home = np.argsort(home, kind="stable")
                    at_home = home[by_home]
                    for c in np.unique(home).tolist() + np.setdiff1d(cell, home).tolist():
                        if (d, k, c) not in parts:
                            continue
                        p_home, p_visits = parts[d, k, c]
                        own = by_home[np.searchsorted(at_home, c) : np.searchsorted(at_home, c, side="right")]
                        seen = of[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
                        part = (mixed[own] % np.uint64(p_home)).astype(int)
                        visit = (mixed[seen] >> np.uint64(32)).astype(np.uint64) % np.uint64(max(p_visits, 1))
                        for i in range(p_home):
                            hs = own[part == i]
                            first = i * (p_home + p_visits + 1)  # others of home part i: itself, earlier parts, visitors
                            tasks = [(OWN_AND_FIRST if p_visits else OWN, first, seen[visit == 0])]
                            tasks += [(EARLIER, first + 1 + j, own[part == j]) for j in range(i)]
                            tasks += [(VISITS, first + p_home + v, seen[visit == v]) for v in range(1, p_visits)]
                            for what, task, others in tasks:
                                for role, who in ((1, hs), (2, others)):
                                    if len(who):
                                        out.append((d, k, (c << 24) + task, what, role, ids[who].astype("<i8").tobytes(), n[who].astype("<i8").tobytes(), x[who].tobytes()))
                                        size += x[who].nbytes
                                if size > DEALT_BYTES:
                                    yield batch(_DEALT_ARROW, *map(list, zip(*out, strict=True)))
                                    out, size = [], 0
            if out:
                yield batch(_DEALT_ARROW, *map(list, zip(*out, strict=True)))

    dealt = classes.mapInArrow(deal, _DEALT)
    found = staged(by_key(dealt, ["d", "block", "cell", "other"], _cell_join(spaces, kind), "kind int, a long, b long"), "vector-links")
    linked = components(found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    reps = classes.join(counts, F.col("rep") == F.col("a"), "left").join(linked, F.col("rep") == F.col("node"), "left")
    reps = reps.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = rows.withColumn("u", F.when(F.col("vec_id").isNotNull(), F.col("embedding"))).join(reps, F.col("u") == F.col("e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def grids(classes: DataFrame, cosine: float) -> dict[int, Subspaces]:
    """The grid of each length of vectors, from their number and the mean and spread of each rotated dimension."""
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("s", pa.float64())])

    def sums(batches):
        for b in batches:
            for d, at in _by_length(b.column("embedding")):
                z = unit(_matrix(b.column("embedding"), at, d)) @ rotation(d)
                yield batch(schema, np.full(2 * d + 1, d, dtype="i4"), np.arange(2 * d + 1, dtype="i4"), np.concatenate([z.sum(axis=0), (z * z).sum(axis=0), [len(z)]]))

    got: dict[int, dict[int, float]] = {}
    for r in classes.select("embedding").mapInArrow(sums, "d int, i int, s double").groupBy("d", "i").agg(F.sum("s").alias("s")).collect():
        got.setdefault(r["d"], {})[r["i"]] = r["s"]
    out = {}
    for d, s in got.items():
        n = s[2 * d]
        mean = np.round([s[i] / n for i in range(d)], 9)
        spread = np.round(np.sqrt(np.maximum([s[d + i] / n for i in range(d)] - mean**2, 0)), 9)
        cuts = int(np.clip(np.ceil(np.log2(max(n * d / SIDE, 1))), LEAST_CUTS, MOST_CUTS))
        out[d] = Subspaces(mean, spread, cuts, cosine)
    return out


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
u AS (SELECT vec_id, e, list_sum([x * x FOR x IN e]) AS q FROM v WHERE e IS NOT NULL),
g AS (SELECT vec_id, e, q FROM u WHERE q > 0 AND isfinite(q)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * sqrt(a.q) * sqrt(b.q)),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = v.vec_id
"""
