"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the hashes of its distinct 5-word shingles.  Two sets at Jaccard similarity of at least 3/4
differ in at most (|A| + |B|) / 7 elements.  The universe of hashes is cut into segments, their number fixed by a size
band; with more segments than differing elements some segment holds the same subset of both sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ROW, Words, batch, bucket_count, by_key, chunks, components, member, mix, pack, pack_small, plain_rows, roots, slots, staged, table, unpack, unpack_small, window_hash, with_row_keys
from .substrings import GROUP_BYTES, grouped

SHINGLE = 5
#: Jaccard threshold NUM / DEN.
NUM, DEN = 75, 100
BAND_GROWTH = 1.8
#: Segments by largest size of a band: 0.42 of it leaves a quarter more non-empty segments than differing elements.
SEGMENT_SHARE = 0.42
#: Bands up to this size use half as many segments, each with its one-deletion neighbourhood.
DELETION_SIZE = 28
#: Segmentations tried for a set that too few segments cover (small sets that hash unevenly), before all such sets meet.
SEEDS = 4
#: Signatures of more sets than this are allotted last.
HOT = 64
#: Blocks of more sets than this count common elements by matrix products.
FEW = 6
#: Up to this many doc_ids (8 bytes each) are sent to all tasks instead of moving the texts.
MOST_SENT_IDS = 1_000_000
#: Documents of one leader are dealt to blocks of about this many.
BLOCK = 256

BANDS = [(1, 2)]
while BANDS[-1][1] < 1 << 31:
    _lo = BANDS[-1][1]
    BANDS.append((_lo, max(_lo + 1, int(np.ceil(_lo * BAND_GROWTH)))))
_HI = np.array([hi for _, hi in BANDS], dtype=np.int64)
#: Largest size that takes part in a band: own sizes are below hi, larger ones come from the bands above.
_REACH = (_HI - 1) * DEN // NUM


def schemes(n: int) -> list[tuple[int, int, int, bool]]:
    """(band, segments, most differing elements, with deletions) of each band in which a set of n elements takes part."""
    out, k = [], int(np.searchsorted(_REACH, n))
    while k < len(BANDS) and BANDS[k][0] <= n:
        lo, hi = BANDS[k]
        partner = n * DEN // NUM if n < hi else hi - 1
        differ = (n + partner) * (DEN - NUM) // (DEN + NUM)
        worst = (hi - 1 + int(_REACH[k])) * (DEN - NUM) // (DEN + NUM)
        deletions = hi <= DELETION_SIZE
        out.append((k, (worst + 2) // 2 + 1 if deletions else max(1, int(np.ceil(SEGMENT_SHARE * hi))), differ, deletions))
        k += 1
    return out


def _segments(tokens: np.ndarray, count: int) -> np.ndarray:
    """Segment of each token; grows with the token, so sorted tokens have sorted segments."""
    return (((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def entries(tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Signatures of a sorted set by band: (signatures, how many the allocation must keep; 0: all).

    Exact bands: one signature per non-empty segment.  Two similar sets have at most `differ` unlike segments, so in any
    common order of signatures the first common one is among the first differ + 1 of both: the allocation keeps that many.  Deletion bands: also each segment less one element; a segment of two or more elements then covers two
    differences, one of a single element covers one.  A set whose segments cover too little goes on to further
    segmentations and at last to a signature that all such sets share.
    """
    out = []
    for band, count, differ, deletions in schemes(len(tokens)):
        parts, covered = [], False
        for seed in range(SEEDS):
            t = tokens if not seed else np.sort(mix(tokens + np.uint64(seed)))
            seg = _segments(t, count)
            names, bounds = slots(seg)
            value = mix(t ^ np.uint64(0x5851F42D4C957F2D))
            sums = np.add.reduceat(value, bounds[:-1])
            size = np.diff(bounds)
            salt = mix((names.astype(np.uint64) << np.uint64(12)) + np.uint64(band << 3 | seed))
            parts.append(mix(sums + salt))
            if deletions:
                many = np.repeat(size > 1, size)
                parts.append(mix(np.repeat(sums + salt, size)[many] - value[many]))
            covered = (np.minimum(size, 2).sum() if deletions else len(names)) > differ
            if covered:
                break
        if not covered:
            parts.append(mix(np.array([band << 3 | 7], dtype=np.uint64)))
        keep = differ + 1 if len(parts) == 1 and covered else 0
        out.append((np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0], keep))
    return out


def _sets(t: pa.Table):
    """(ids, tokens, bounds) by chunk: sorted distinct shingle hashes of each text of a group."""
    ids = t.column("doc_id").to_numpy()
    for i, j, data, offsets in chunks(t.column("text")):
        yield ids[i:j], *shingle_sets(data, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    n = max(len(h) - SHINGLE + 1, 0)
    whole = np.arange(n) + SHINGLE <= w.first[1:][w.doc[:n]]
    tokens, docs = window_hash(h, SHINGLE)[whole], w.doc[:n][whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        place = np.arange(len(h)) - w.first[w.doc]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15))])
        extra = mix(sums[w.first[short + 1]] - sums[w.first[short]] + w.counts[short].astype(np.uint64))
        tokens, docs = np.concatenate([tokens, extra]), np.concatenate([docs, short])
    order = np.lexsort((tokens, docs))
    tokens, docs = tokens[order], docs[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (docs[1:] != docs[:-1])
    tokens, docs = tokens[new], docs[new]
    return tokens, np.searchsorted(docs, np.arange(len(offsets)))


_SAID = "bucket int, grp int, ids binary, sizes binary, sigs binary, odd binary, counts binary"
_SAID_ARROW = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "sigs", "odd", "counts"))])
_HEARD = "grp int, bucket int, sigs binary, leaders binary, counts binary"
_HEARD_ARROW = pa.schema([("grp", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "leaders", "counts"))])
_ROWS = "leader long, block int, kind int, doc long, tokens binary"
_ROWS_ARROW = pa.schema([("leader", pa.int64()), ("block", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("tokens", pa.binary())])
#: Kind of a row: 0 a member of the leader, 1 a link of equal sets, SIZES the ids, sizes and flags of a group's rows,
#: LEADER + n the leader itself, of n blocks.
SIZES, NO_ID, LEADER = 8, 9, 16
SIZES_BLOCK = -(1 << 30)
_LINKS = "kind int, a long, b long"
_LINKS_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
#: Bytes of a signature that travel, besides the bucket it lies in; a chance agreement only adds a candidate.
SIG_BYTES = 4
SET_BYTES = 6


def _group_entries(t: pa.Table, sizes: list | None = None):
    """Of a group: one record (key, least id, tokens, equal ids) for each distinct set; the size of every row's set is
    added to sizes.  Rows without an id have no part in the sets."""
    classes: dict[tuple, list] = {}
    no_id = iter(t.column("no_id").to_pylist())
    for ids, tokens, bounds in _sets(t):
        if sizes is not None:
            sizes.append(np.diff(bounds))
        for k, (doc, none) in enumerate(zip(ids.tolist(), no_id)):  # noqa: B905  no_id goes on to the next chunk
            own = tokens[bounds[k] : bounds[k + 1]]
            if len(own) and not none:
                key = (len(own), int(np.add.reduce(own)), int(np.add.reduce(mix(own + np.uint64(77)))))
                classes.setdefault(key, [own, []])[1].append(doc)
    for key, (own, ids) in classes.items():
        yield key, min(ids), own, ids


def _class_signatures(key: tuple) -> np.ndarray:
    """Two independent signatures that only equal sets share both of."""
    return mix(np.array([key[1], key[2]], dtype=np.uint64) + np.uint64(key[0] << 8 | 0xC5))


def _say(buckets: int):
    def say(key, t):
        sigs, owners = [], []
        for ck, least, own, _ in _group_entries(t):
            e = [x for x, _ in entries(own)] + [_class_signatures(ck)]
            e = np.concatenate(e)
            sigs.append(e)
            owners.append(np.full(len(e), least, dtype=np.int64))
        if not sigs:
            return _SAID_ARROW.empty_table()
        s, o = np.concatenate(sigs), np.concatenate(owners)
        order = np.lexsort((o, s))
        s, o = s[order], o[order]
        first, bounds = slots(s)
        o, n = o[bounds[:-1]], np.diff(bounds)
        at = first % np.uint64(buckets)
        order = np.lexsort((first, o, at))
        first, o, n, at = first[order], o[order], n[order], at[order]
        names, cut = slots(at)
        rows = []
        for a, b in zip(cut, cut[1:], strict=False):
            ids, of = slots(o[a:b])
            odd = np.flatnonzero(n[a:b] > 1)
            rows.append((pack_small(ids), pack_small(np.diff(of)), pack(first[a:b] >> np.uint64(32), SIG_BYTES), pack_small(odd), pack_small(n[a:b][odd])))
        return pa.Table.from_batches([batch(_SAID_ARROW, names.astype("i4"), np.full(len(names), key[0].as_py(), dtype="i4"), *map(list, zip(*rows, strict=True)))])

    return say


def _lead(key, rows):
    """Of one bucket: to each group its signatures that two sets anywhere share, with the least id and the count."""
    sig, ids, n = [], [], []
    for r in rows:
        sig.append(unpack(r[4], SIG_BYTES))
        ids.append(np.repeat(unpack_small(r[2]).astype(np.int64), unpack_small(r[3]).astype(np.int64)))
        c = np.ones(len(sig[-1]), dtype=np.int64)
        c[unpack_small(r[5]).astype(np.int64)] = unpack_small(r[6])
        n.append(c)
    src = np.repeat(np.arange(len(rows)), [len(x) for x in sig])
    sig, ids, n = np.concatenate(sig), np.concatenate(ids), np.concatenate(n)
    order = np.lexsort((ids, sig))
    sig, ids, n, src = sig[order], ids[order], n[order], src[order]
    _, bounds = slots(sig)
    total, size = np.add.reduceat(n, bounds[:-1]), np.diff(bounds)
    good = np.repeat(total > 1, size)
    lead, total = np.repeat(ids[bounds[:-1]], size)[good], np.repeat(total, size)[good]
    sig, src = sig[good], src[good]
    order = np.argsort(src, kind="stable")
    names, cut = slots(src[order])
    if len(names):
        parts = [order[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        yield batch(_HEARD_ARROW, np.array([rows[k][1] for k in names], dtype="i4"), np.full(len(names), key[0], dtype="i4"), [pack(sig[p], SIG_BYTES) for p in parts], [pack_small(lead[p]) for p in parts], [pack_small(total[p]) for p in parts])


def _allot(buckets: int):
    """Of a group: the sizes of its sets, and each set with a shared signature, once per leader its allocation keeps."""

    def size_row(grp: int, t: pa.Table, sizes: list):
        flags = np.array(t.column("no_id").to_pylist(), dtype=np.uint8)
        raw = t.column("doc_id").to_numpy().astype("<i8").tobytes() + np.concatenate(sizes).astype("<i8").tobytes() + flags.tobytes()
        return grp, SIZES_BLOCK, SIZES, t.num_rows, raw

    def allot(key, t, heard):
        if not t.num_rows:
            return _ROWS_ARROW.empty_table()
        sizes: list = []
        if not heard.num_rows:
            for _ in _group_entries(t, sizes):
                pass
            return pa.Table.from_batches([batch(_ROWS_ARROW, *map(list, zip(size_row(key[0].as_py(), t, sizes), strict=True)))])
        hs = np.concatenate([unpack(x, SIG_BYTES) | np.uint64(k << 32) for k, x in zip(heard.column("bucket").to_pylist(), heard.column("sigs").to_pylist(), strict=True)])
        hl = np.concatenate([unpack_small(x).astype(np.int64) for x in heard.column("leaders").to_pylist()])
        hc = np.concatenate([unpack_small(x) for x in heard.column("counts").to_pylist()])
        order = np.argsort(hs)
        hs, hl, hc = hs[order], hl[order], hc[order].astype(np.int64)

        def look(sig):
            full = (sig >> np.uint64(32)) | ((sig % np.uint64(buckets)) << np.uint64(32))
            at = np.searchsorted(hs, full)
            at[at == len(hs)] = 0
            hit = hs[at] == full
            return full, np.where(hit, hl[at], -1), np.where(hit, hc[at], 1)

        out = []
        for ck, least, own, ids in _group_entries(t, sizes):
            _, top, n = look(_class_signatures(ck))
            out += [(least, -1, 1, d, None) for d in set(ids) if d != least]
            if n.min() > 1 and top[0] == top[1] and top[0] < least:  # an equal set stands for this one
                out.append((int(top[0]), -2 - least % 4096, 1, least, None))
                continue
            blocks: dict[int, int] = {}
            lead_size, alone = 0, True
            for sig, keep in entries(own):
                full, lead, count = look(sig)
                shared = count > 1
                mine = shared & (lead == least)
                if mine.any():
                    lead_size = max(lead_size, int(count[mine].max()))
                if keep:
                    # of a similar set at least len(sig) - (keep - 1) signatures are common
                    if shared.sum() < len(sig) - keep + 1:
                        continue
                    order = np.lexsort((full, lead, count > HOT, shared))[:keep]
                    lead, count, shared = lead[order], count[order], shared[order]
                alone &= not shared.any()
                for a, c in zip(lead[shared].tolist(), count[shared].tolist(), strict=True):
                    blocks[a] = max(blocks.get(a, 0), c)
            raw = None if alone else pack(own >> np.uint64(16), SET_BYTES)
            n = -(-lead_size // BLOCK)
            if n > 1 or n and not alone:
                out += [(least, b, LEADER + n, least, raw) for b in range(n)]
            for a, c in blocks.items():
                if a != least:
                    out.append((a, int(mix(np.array([least], dtype=np.int64).astype(np.uint64))[0] % np.uint64(-(-c // BLOCK))), 0, least, raw))
        out.append(size_row(key[0].as_py(), t, sizes))
        return pa.Table.from_batches([batch(_ROWS_ARROW, *map(list, zip(*out, strict=True)))])

    return allot


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact verification on sorted sets."""
    if min(len(a), len(b)) * DEN < NUM * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int(member(a, b).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], fresh: int | None = None) -> list[tuple[int, int]]:
    """Links (by position) that connect exactly what the similar pairs of a block connect; with fresh, of pairs with one of
    the first `fresh` sets.  A few sets are compared one by one, more of them by counting common elements in matrix
    products."""
    n, own = len(sets), fresh or len(sets)
    if n < 2:
        return []
    if n <= FEW:
        pairs = [(i, j) for i in range(own) for j in range(i + 1, n) if similar(sets[i], sets[j])]
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    else:
        size = np.array([len(x) for x in sets])
        doc = np.repeat(np.arange(n), size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[token] > 1
        doc, (_, token) = doc[keep], np.unique(token[keep], return_inverse=True)
        order = np.argsort(token, kind="stable")
        doc, token = doc[order], token[order]
        both = np.zeros((own, n), dtype=np.float32)
        step = max(1, (1 << 22) // n)
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
            x, y = np.searchsorted(token, [lo, lo + step])
            m = np.zeros((n, step), dtype=np.float32)
            m[doc[x:y], token[x:y] - lo] = 1
            both += m[:own] @ m.T
        a, b = np.nonzero(DEN * both >= NUM * (size[:own, None] + size - both))
    root = roots(n, a, b)
    return [(i, r) for i, r in enumerate(root.tolist()) if i != r]


def _verify(key, rows):
    """Of one block of a leader: links (kind 0); if the leader has more blocks, its other members (kind 1: joined to the
    leader here, 2: not).  Of a group's sizes: a row for each (kind SIZES, or NO_ID where the id is null)."""
    if rows[0][2] == SIZES:
        for r in rows:
            n = r[3]
            both = np.frombuffer(r[4][: 16 * n], dtype="<i8")
            flags = np.frombuffer(r[4][16 * n :], dtype=np.uint8)
            yield batch(_LINKS_ARROW, np.where(flags, NO_ID, SIZES).astype("i4"), both[:n], both[n:])
        return
    out = [(0, r[3], r[0]) for r in rows if r[2] == 1]
    members = sorted({(r[3], r[4]) for r in rows if r[4] is not None})
    docs = [d for d, _ in members]
    joined = link_block([unpack(raw, SET_BYTES) for _, raw in members])
    out += [(0, docs[i], docs[j]) for i, j in joined]
    if max(r[2] for r in rows) > LEADER + 1:
        root = np.arange(len(docs))
        for i, j in joined:
            root[i] = j
        near = {int(root[i]) for i, d in enumerate(docs) if d == key[0]}
        out += [(1 if int(root[i]) in near else 2, key[0], d) for i, d in enumerate(docs)]
    if out:
        yield batch(_LINKS_ARROW, *map(list, zip(*out, strict=True)))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) of documents by doc_id that connect exactly the documents connected by similar pairs,
    (doc_id, n_shingles) of every row).

    Pass one: each group of documents says every signature of its distinct sets once, with the least doc_id and a count;
    buckets of signatures answer with the least doc_id anywhere, the leader, and the whole count.  Pass two: each set
    allots its budget of signatures by cost: those of no other set cost nothing and come first, then those of at most
    HOT sets, a leader's together, then the others.  A set that shares too few signatures for any similar partner is
    done.  Sets that share a leader meet in blocks of about BLOCK, where
    similar pairs are verified on whole sets.  A leader of more sets goes to every one of its blocks; sets of such a
    leader that it doesn't connect are compared with all of its other blocks in a second round.
    """
    texts = grouped(docs, bucket_count(docs, GROUP_BYTES))
    buckets = bucket_count(docs)
    heard = by_key(texts.groupBy("grp").applyInArrow(_say(buckets), _SAID), ["bucket"], _lead, _HEARD)
    rows = texts.groupBy("grp").cogroup(heard.groupBy("grp")).applyInArrow(_allot(buckets), _ROWS)
    found = staged(by_key(rows, ["leader", "block"], _verify, _LINKS), "ngram-links")
    sizes = found.where(F.col("kind").isin(SIZES, NO_ID)).select(F.when(F.col("kind") == SIZES, F.col("a")).alias("doc_id"), F.col("b").alias("n_shingles"))
    sure = found.where("kind = 0").select("a", "b")
    if not found.where("kind = 2").isEmpty():
        sure = sure.unionByName(_strays(docs, found.where("kind IN (1, 2)")))
    return sure, sizes


def _strays(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links of sets that their leader doesn't connect with all sets of that leader, block by block."""
    stats = members.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == 2).alias("strays")).where("strays > 0")
    blocks = stats.select("a", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # apart from a leader, which is in each of its blocks, a leader's members are there once; its rows may be split at will
    # a document with several texts (a repeated doc_id) counts once, as a stray if one of them is
    m = members.where("a <> b OR kind = 2").groupBy("a", F.col("b").alias("doc")).agg((F.max("kind") == 2).alias("stray")).join(blocks, "a")
    home = F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("block")
    homes = m.where("a <> doc").unionByName(blocks.select("a", F.col("a").alias("doc"), F.lit(False).alias("stray"), "blocks")).select("a", "doc", home, F.lit(0).alias("kind"))
    guests = m.where("stray").select("a", "doc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"))
    need = homes.unionByName(guests)

    def tokens(batches):
        schema = pa.schema([("doc", pa.int64()), ("tokens", pa.binary())])
        for b in batches:
            for ids, t, bounds in _sets(pa.Table.from_batches([b])):
                yield batch(schema, ids.astype("i8"), [pack(t[x:y] >> np.uint64(16), SET_BYTES) for x, y in zip(bounds, bounds[1:], strict=False)])

    ids = staged(homes.select("doc").distinct(), "ngram-strays")
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT_IDS else ids
    wanted = docs.join(ids, docs["doc_id"] == ids["doc"], "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = wanted.mapInArrow(tokens, "doc long, tokens binary").dropDuplicates(["doc", "tokens"])

    def compare(key, rows):
        guests = [r for r in rows if r[3] == 1]
        names = {r[1] for r in guests}
        every = guests + [r for r in rows if r[3] == 0 and r[1] not in names]
        got = link_block([unpack(r[4], SET_BYTES) for r in every], len(guests)) if guests else []
        if got:
            yield batch(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [every[i][1] for i, _ in got], [every[j][1] for _, j in got])

    joined = need.join(sets, "doc").select("a", "doc", "block", "kind", "tokens")
    return by_key(joined, ["a", "block"], compare, "a long, b long")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are lower-cased in A-Z; texts of fewer than five words are one shingle; texts without words and null texts
    have an empty set, linked with nothing.  Equal sets are linked whatever their number, through the least doc_id.
    Repeated doc_ids are one node, linked by any of its texts; a null doc_id has a null component and links nothing by
    itself.  An empty table gives no rows; other columns are not read.  Sets are counted by 64-bit and compared by 48-bit
    shingle hashes: of two sets that differ in d shingles, a common one too many is seen with probability d * d / 2**48.
    """
    found, sizes = links(docs)
    found = components(found)
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar texts: the one with the least doc_id (null last), then the least key.

    Every row is a text of its own, whatever its doc_id, so of rows equal in all columns one stays; texts without words are
    similar to none and all stay.  Columns are unchanged; an empty table gives no rows.
    """
    keyed = with_row_keys(docs)
    found = similar_components(keyed.select(F.col(ROW).alias("doc_id"), "row.text")).where("component_id IS NOT NULL")
    ids = keyed.select(F.col(ROW).alias("i_row"), F.col("row.doc_id").alias("i_id"))
    order = F.struct(F.col("i_id").isNull().alias("none"), F.coalesce("i_id", F.lit(0)).alias("id"), F.col("i_row").alias("row"))
    members = found.join(ids, F.col("doc_id") == F.col("i_row")).select("component_id", "i_row", order.alias("o"))
    # one row a component stays: a join on keys of rows, so that a component of very many rows is no hot key
    stay = members.groupBy("component_id").agg(F.min("o").alias("first")).select(F.col("first.row").alias("stay_row"))
    return plain_rows(keyed.join(stay, F.col(ROW) == F.col("stay_row"), "left_semi"), docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM g),
t AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
