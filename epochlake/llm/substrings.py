"""Substring dedup by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, batch, bucket_count, by_key, chunks, member, pack, slots, staged, table, unpack, window_hash

WINDOW = 13
#: What a null doc_id counts as.
NO_ID = (1 << 63) - 1
GROUP_BYTES = 3 << 20


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """Texts in groups by doc_id, text and the partition they are read from: the one exchange of texts, which every level reads
    again.  Rows equal in both, or without either, meet in one group only as far as one partition holds them; a row's group
    does not depend on the order of rows, so a task that runs again deals them alike."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).cast("int").alias("grp"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")


def _half(width: int) -> int:
    return (width + 1) // 2


def _views(t: pa.Table):
    """Word hashes of each chunk of a group: (ids by text, Words, hashes)."""
    ids = t.column("doc_id").to_numpy()
    for i, j, data, offsets in chunks(t.column("text")):
        w = Words(data, offsets)
        yield ids[i:j], w, w.hashes()


def _starts(w: Words, n: int, width: int) -> np.ndarray:
    """Which of the first n window starts have their whole window in one text."""
    return np.arange(n) + width <= w.first[1:][w.doc[:n]]


def _seeds(w: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` words the least hash of the half-length windows inside, and whether it is whole.

    Equal windows have equal seeds, and neighbours mostly share theirs: about a quarter of the positions remain.
    """
    half = _half(width)
    n = max(len(h) - width + 1, 0)
    a = window_hash(h, half, 1)
    least = a[:n].copy()
    for k in range(1, width - half + 1):
        np.minimum(least, a[k : k + n], out=least)
    return least, _starts(w, n, width)


def _runs(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and whether two documents of the group have them."""
    order = np.lexsort((ids, values))
    values, ids = values[order], ids[order]
    first, bounds = slots(values)
    return first, ids[bounds[1:] - 1] != ids[bounds[:-1]] if len(first) else np.zeros(0, dtype=bool)


_SAID = "bucket int, grp int, vals binary, more binary"
_SAID_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("vals", pa.binary()), ("more", pa.binary())])
_HEARD = "grp int, vals binary"
_HEARD_ARROW = pa.schema([("grp", pa.int32()), ("vals", pa.binary())])


def _say(grp: int, values: np.ndarray, more: np.ndarray, buckets: int, pack_more):
    at = (values & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    order = np.argsort(at, kind="stable")
    names, bounds = slots(at[order])
    parts = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return batch(_SAID_ARROW, names.astype("i4"), np.full(len(names), grp, dtype="i4"), [pack(values[p] >> np.uint64(16), 6) for p in parts], [pack_more(more[p]) for p in parts]).to_pylist()


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _repeated(key, rows):
    """Of one bucket: to each group the values that two documents anywhere have."""
    vals = [unpack(r[2], 6) for r in rows]
    more = [np.unpackbits(np.frombuffer(r[3], dtype=np.uint8))[: len(v)] for r, v in zip(rows, vals, strict=True)]
    v, m = np.concatenate(vals), np.concatenate(more)
    src = np.repeat(np.arange(len(rows)), [len(x) for x in vals])
    order = np.argsort(v, kind="stable")
    v, m, src = v[order], m[order], src[order]
    _, bounds = slots(v)
    size = np.diff(bounds)
    good = np.repeat((size > 1) | (np.add.reduceat(m.astype(np.int64), bounds[:-1]) > 0), size)
    v, src = v[good], src[good]
    order = np.argsort(src, kind="stable")
    v, src = v[order], src[order]
    names, bounds = slots(src)
    if len(names):
        yield batch(_HEARD_ARROW, np.array([rows[k][1] for k in names], dtype="i4"), [pack(v[a:b], 6) for a, b in zip(bounds, bounds[1:], strict=False)])


def _heard(t: pa.Table, kind: int | None = None) -> np.ndarray:
    raw = [x for k, x in zip(t.column("kind").to_pylist() if kind is not None else [None] * t.num_rows, t.column("vals").to_pylist(), strict=True) if k == kind]
    return np.unique(np.concatenate([unpack(x, 6) for x in raw])) if raw else np.zeros(0, dtype=np.uint64)


def _bits(m: np.ndarray) -> bytes:
    return np.packbits(m).tobytes()


def seed_level(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """(grp, vals): half-length seeds of `width`-word windows that two documents have."""

    def say(key, t):
        values, ids = [], []
        for doc_ids, w, h in _views(t):
            v, whole = _seeds(w, h, width)
            d = w.doc[: len(v)][whole]
            v = v[whole]
            keep = np.ones(len(v), dtype=bool)
            keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
            values.append(v[keep])
            ids.append(doc_ids[d[keep]])
        return _said(key, values, ids, buckets)

    return by_key(texts.groupBy("grp").applyInArrow(say, _SAID), ["bucket"], _repeated, _HEARD)


def _said(key, values: list[np.ndarray], ids: list[np.ndarray], buckets: int) -> pa.Table:
    if not values or not sum(map(len, values)):
        return _SAID_ARROW.empty_table()
    v, m = _runs(np.concatenate(values), np.concatenate(ids))
    return _table(_SAID_ARROW, _say(key[0].as_py(), v, m, buckets, _bits))


def half_level(texts: DataFrame, seeds: DataFrame, width: int, buckets: int) -> DataFrame:
    """(grp, vals): windows of half the width that two documents have, out of the two halves (overlapping where the width
    is odd) of every window whose seed repeats; a whole window can only repeat if both do."""
    half = _half(width)

    def say(key, t, heard):
        known = _heard(heard)
        values, ids = [], []
        for doc_ids, w, h in _views(t):
            v, whole = _seeds(w, h, width)
            at = np.flatnonzero(whole & member(v >> np.uint64(16), known))
            if len(at):
                at = np.union1d(at, at + width - half)
                values.append(window_hash(h, half, 1)[at])
                ids.append(doc_ids[w.doc[at]])
        return _said(key, values, ids, buckets)

    said = texts.groupBy("grp").cogroup(seeds.groupBy("grp")).applyInArrow(say, _SAID)
    return by_key(said, ["bucket"], _repeated, _HEARD)


def _both_halves(h: np.ndarray, n: int, width: int, known: np.ndarray) -> np.ndarray:
    """Which of the first n windows have both halves among the repeated ones."""
    half = _half(width)
    hit = member(window_hash(h, half, 1) >> np.uint64(16), known)
    return hit[:n] & hit[width - half : width - half + n]


def double_level(texts: DataFrame, before: DataFrame, width: int, buckets: int) -> DataFrame:
    """(grp, vals): windows of 2 * width words that two documents have, out of those with both halves in `before`."""

    def say(key, t, heard):
        known = _heard(heard)
        values, ids = [], []
        for doc_ids, w, h in _views(t):
            n = len(h) - 2 * width + 1
            if n <= 0 or not len(known):
                continue
            hit = member(window_hash_long(h, width) >> np.uint64(16), known)
            ok = hit[:n] & hit[width : width + n] & _starts(w, n, 2 * width)
            values.append(window_hash_long(h, 2 * width)[:n][ok])
            ids.append(doc_ids[w.doc[:n][ok]])
        return _said(key, values, ids, buckets)

    said = texts.groupBy("grp").cogroup(before.groupBy("grp")).applyInArrow(say, _SAID)
    return by_key(said, ["bucket"], _repeated, _HEARD)


def window_hash_long(h: np.ndarray, width: int) -> np.ndarray:
    """Window hashes for widths WINDOW * 2**k: a window is the pair of its halves."""
    if width % 2 or width // 2 < WINDOW // 2 + 1:
        return window_hash(h, width, 2)
    a = window_hash_long(h, width // 2)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return window_hash(np.stack([a[:n], a[width // 2 : width // 2 + n]]).T.ravel(), 2, 3)[::2]


def _holders(width: int):
    """Of a group: the documents with a window of a level."""

    def holders(key, t, heard):
        known = _heard(heard)
        ids = set()
        for doc_ids, w, h in _views(t):
            v = window_hash_long(h, width)
            ids.update(doc_ids[w.doc[: len(v)][member(v >> np.uint64(16), known) & _starts(w, len(v), width)]].tolist())
        return pa.table({"doc_id": pa.array(sorted(ids), pa.int64()), "longest": pa.array([width] * len(ids), pa.int64())})

    return holders


def longest_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, longest): the greatest width * 2**k so that the document shares a window of that many words with another
    document; absent if not even `width` words are shared.  Only windows both of whose halves repeat are extended; the
    levels end when no candidate survives.

    Null and empty texts share nothing; rows that repeat a doc_id are one document's and share nothing with each other; null
    doc_ids are one document, 2**63 - 1; an empty table gives no rows; other columns are not read."""
    texts = staged(grouped(docs, bucket_count(docs, GROUP_BYTES)), "grouped-texts")  # levels are queries of their own
    buckets = bucket_count(docs)
    halves = half_level(texts, seed_level(texts, width, buckets), width, buckets)

    def first(key, t, heard):
        known = _heard(heard)
        values, ids = [], []
        for doc_ids, w, h in _views(t):
            n = max(len(h) - width + 1, 0)
            ok = _starts(w, n, width) & _both_halves(h, n, width, known)
            values.append(window_hash_long(h, width)[:n][ok])
            ids.append(doc_ids[w.doc[:n][ok]])
        return _said(key, values, ids, buckets)

    level = staged(by_key(texts.groupBy("grp").cogroup(halves.groupBy("grp")).applyInArrow(first, _SAID), ["bucket"], _repeated, _HEARD), "repeats")
    out, at = None, width
    while not level.isEmpty():
        found = texts.groupBy("grp").cogroup(level.groupBy("grp")).applyInArrow(_holders(at), "doc_id long, longest long")
        out = found if out is None else out.unionByName(found)
        level = staged(double_level(texts, level, at, buckets), "repeats")
        at *= 2
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest long")
    return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))


# -- removal -------------------------------------------------------------------

_OWN = "bucket int, grp int, vals binary, ids binary"
_OWN_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("vals", pa.binary()), ("ids", pa.binary())])
_PAIR = np.dtype([("h", "<u8"), ("g", "<u2")])


def _candidates(t: pa.Table, known: np.ndarray, width: int):
    """Of a group: hashes h, g of surviving windows, and document ids; with (Words, positions) by chunk."""
    views, hs, gs, ids = [], [], [], []
    for doc_ids, w, h in _views(t):
        n = max(len(h) - width + 1, 0)
        at = np.flatnonzero(_starts(w, n, width) & _both_halves(h, n, width, known)) if len(known) else np.zeros(0, dtype=np.int64)
        views.append((doc_ids, w, at))
        hs.append(window_hash(h, width, 2)[at] if len(at) else np.zeros(0, dtype=np.uint64))
        gs.append(window_hash(h, width, 3)[at] if len(at) else np.zeros(0, dtype=np.uint64))
        ids.append(doc_ids[w.doc[at]] if len(at) else np.zeros(0, dtype=np.int64))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.uint64)
    return views, cat(hs), cat(gs), cat(ids).astype(np.int64)


def _owners(h: np.ndarray, g: np.ndarray, ids: np.ndarray):
    """Distinct windows with the least id that has them, and the index of its window for each row."""
    order = np.lexsort((ids, g, h))
    hh, gg = h[order], g[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hh[1:] != hh[:-1]) | (gg[1:] != gg[:-1])
    slot = np.empty(len(order), dtype=np.int64)
    slot[order] = np.cumsum(new) - 1
    return hh[new], gg[new], ids[order][new], slot


def removed_words(docs: DataFrame, width: int = WINDOW, texts_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): each word covered by a `width`-word window is removed if
    that word sequence also starts in a document with a smaller doc_id, judged on the input.

    Filter: half-length seeds (the least hash in a window, about a quarter of the positions) are pre-aggregated per group
    of documents, so a passage in a third of all documents costs one entry per group.  Level one: of the windows whose seed
    repeats, the two windows of half the length (7 words, overlapping by one) are compared, all of them.  Level two: only
    where both halves repeat, the window of `width` words is compared: per group its least doc_id is sent, and a group
    hears which of its windows start in a smaller document elsewhere; inside a group they are compared at hand.  A group
    without surviving candidates sends nothing.  Windows are told apart by 64 + 16 hash bits besides the bucket's; longer
    levels cannot change what is removed, longest_repeats goes on doubling until no candidate survives.

    Null texts have no words; texts shorter than `width` lose none; rows that repeat a doc_id are one document's, none
    smaller than the other; null doc_ids count as 2**63 - 1; an empty table gives no rows; other columns are not read.
    """
    groups, buckets = bucket_count(docs, GROUP_BYTES), bucket_count(docs)
    texts = grouped(docs, groups)
    halves = half_level(texts, seed_level(texts, width, buckets), width, buckets).withColumn("kind", F.lit(0))

    def say(key, t, heard):
        known = _heard(heard, 0)
        _, h, g, ids = _candidates(t, known, width)
        if not len(h):
            return _OWN_ARROW.empty_table()
        h, g, ids, _ = _owners(h, g, ids)
        at = (g & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        names, bounds = slots(at[order])
        parts = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        both = np.empty(len(h), dtype=_PAIR)
        both["h"], both["g"] = h, (g >> np.uint64(48)).astype("<u2")
        return pa.Table.from_batches([batch(_OWN_ARROW, names.astype("i4"), np.full(len(names), key[0].as_py(), dtype="i4"), [both[p].tobytes() for p in parts], [ids[p].astype("<i8").tobytes() for p in parts])])

    def judge(key, rows):
        pairs = [np.frombuffer(r[2], dtype=_PAIR) for r in rows]
        p, ids = np.concatenate(pairs), np.concatenate([np.frombuffer(r[3], dtype="<i8") for r in rows])
        src = np.repeat(np.arange(len(rows)), [len(x) for x in pairs])
        _, _, least, slot = _owners(p["h"].astype(np.uint64), p["g"].astype(np.uint64), ids)
        late = ids > least[slot]
        p, src = p[late], src[late]
        order = np.argsort(src, kind="stable")
        names, bounds = slots(src[order])
        if len(names):
            yield batch(_HEARD_ARROW, np.array([rows[k][1] for k in names], dtype="i4"), [p[order[a:b]].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])

    said = texts.groupBy("grp").cogroup(halves.groupBy("grp")).applyInArrow(say, _OWN)
    late = by_key(said, ["bucket"], judge, _HEARD).withColumn("kind", F.lit(1))
    columns = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * texts_out
    schema = pa.schema(columns)

    def finish(key, t, heard):
        views, h, g, ids = _candidates(t, _heard(heard, 0), width)
        if len(h):
            hh, gg, least, slot = _owners(h, g, ids)
            raw = [np.frombuffer(x, dtype=_PAIR) for k, x in zip(heard.column("kind").to_pylist(), heard.column("vals").to_pylist(), strict=True) if k == 1]
            far = np.zeros(len(hh), dtype=bool)
            if raw:
                told = np.concatenate(raw)
                told = np.unique(told["h"] ^ (told["g"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                far = member(hh ^ ((gg >> np.uint64(48)) * np.uint64(0x9E3779B97F4A7C15)), told)
            bad = (ids > least[slot]) | far[slot]
        out, at, no_id = [], 0, iter(t.column("no_id").to_pylist())
        for doc_ids, w, pos in views:
            n = len(w.starts)
            cover = np.zeros(n + 1, dtype=np.int32)
            if len(pos):
                hit = pos[bad[at : at + len(pos)]]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + width, -1)
            at += len(pos)
            gone = np.cumsum(cover[:n]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])[w.first]
            raw_text = w.data
            for k, doc in enumerate(doc_ids.tolist()):
                words = raw_text[w.offsets[k] : w.offsets[k + 1]].tobytes().split()
                a, b = w.first[k], w.first[k + 1]
                cut = int(lost[k + 1] - lost[k])
                if cut:
                    words = [x for x, y in zip(words, gone[a:b].tolist(), strict=True) if not y]
                kept = b" ".join(words)
                out.append((None if next(no_id) else doc, int(b - a), cut, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts_out else [])))
        return pa.Table.from_batches([batch(schema, *map(list, zip(*out, strict=True)))]) if out else schema.empty_table()

    told = halves.unionByName(late)
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts_out
    return texts.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(finish, ddl)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(*) > 1),
b AS (SELECT DISTINCT doc_id, i FROM g JOIN m USING (s) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM b, range(13) AS t(k)),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(gone, j)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
