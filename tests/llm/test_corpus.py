"""The pipeline's stages, and what they call, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_operators import MORE, SECRET, brute_components, brute_spans, shingles, words

from epochlake.llm import mixing, ngram_join, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, row_key long, count long, size string"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def odd_rows():
    """Repeated and null ids, repeated rows, equal texts, near copies, secrets, nulls, clashing columns."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    good = [text(80) for _ in range(14)]
    near = [g + " tail" for g in good[:4]]
    out = [(1, good[0]), (1, "a b"), (2, good[1]), (2, good[1]), (3, good[1]), (None, good[1]), (None, good[2]), (None, good[3]), (None, "x"), (4, good[3]), (4, good[4])]
    out += [(10 + i, t) for i, t in enumerate(good[5:] + near)] + [(50, f"{good[5]} {SECRET[0]} {text(60)}"), (51, f"{text(60)} {SECRET[2]} {MORE[1]}"), (None, f"{SECRET[1]} {text(70)}"), (60, None), (61, "")]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None]), len(t or "")) for i, t in out]
    rows += [rows[4]] * 3
    return [(*r, "r", 7, 8, "z") for r in rows]


def plain(df):
    return Counter(tuple(r) for r in df.select(*NAMES).collect())


@pytest.fixture(scope="module")
def data():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def base_failed(t):
    w = words(t)
    n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_stage_decides_by_row(spark, data, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0)], "doc_id long, quality int")
    got = quality.kept_documents(docs, labels)
    assert got.columns == docs.columns
    assert plain(got) == Counter(r[:5] for r in data if not base_failed(r[1]))


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, data, docs):
    root = brute_components({i: shingles(r[1]) for i, r in enumerate(data)})
    least = {}
    for i, r in enumerate(data):
        k = (r[0] is None, r[0] or 0)
        least[root[i]] = min(least.get(root[i], k), k)
    group = {r[1]: root[i] for i, r in enumerate(data) if words(r[1])}
    got = ngram_join.representatives(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    kept = Counter((group[r["text"]], (r["doc_id"] is None, r["doc_id"] or 0)) for r in rows if words(r["text"]))
    assert kept == Counter((g, least[g]) for g in set(group.values()))
    assert sum(not words(r["text"]) for r in rows) == sum(not words(r[1]) for r in data)


def test_secret_stage(spark, data, docs):
    def clean(t):
        return re.sub(r"eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+", secrets_mark, secrets.redact(t, brute_spans(t))) if t else t

    secrets_mark = "[REDACTED]"
    want = Counter()
    for i, t, lang, source, n in (r[:5] for r in data):
        c = clean(t)
        want[i, c, lang, source, n if c == t else len(c)] += 1
    got = secrets.redacted_documents(docs, secrets.new_ledger(spark))
    assert got.columns == docs.columns and plain(got) == want
    assert sum("[REDACTED]" in (k[1] or "") for k in want) == 3


def taken_by_hand(rows):
    """Words taken of each row (by position) and the text left of its last copy."""
    size = [len(words(r[1])) for r in rows]
    source = Counter()
    for r, n in zip(rows, size, strict=True):
        source[r[3]] += n
    names = sorted([s for s in source if s is not None]) + [None] * (None in source)
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    target, left = {}, dict(weight)
    while left:
        level = (1.5 * sum(source.values()) - sum(target.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > 2 * source[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * source[s]
            del left[s]
    target |= {s: level * w for s, w in left.items()}
    out = [0] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[3] == s]
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        own.sort(key=lambda i: (md5(f"{mixing.SEED}:{'' if rows[i][0] is None else rows[i][0]}:{md5(rows[i][1] or '')}"), size[i]))
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, source[s]) if source[s] else (0, 0)
        for i in own:
            out[i] = epochs * size[i] + min(size[i], rest)
            rest -= min(size[i], rest)
    return size, out


def test_mix_stage_delivers_every_row(spark, data, docs):
    size, taken = taken_by_hand(data)
    want = Counter()
    for r, n, t in zip(data, size, taken, strict=True):
        while t > 0:
            want[r[0], r[3], r[1] if t >= n else " ".join(words(r[1])[:t])] += 1
            t -= n
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in got.collect()) == want
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == sum(taken)


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(10)), "a", "s", 5)] * 7
    docs = spark.createDataFrame([(*r, "r", 7, 8, "z") for r in rows], SCHEMA)
    took = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert took == 105 == sum(len(words(r["text"])) for r in mixing.mixed_documents(docs).collect())


def test_stages_of_an_empty_table(spark, docs, sf):
    import corpus_pipeline

    out = docs.where("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        assert out.count() == 0, name


def upper_is_over(k, n, share, error):
    """Whether the exact upper bound of a share of which k in n were seen lies above share."""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share)) for i in range(k + 1)) > error


def test_certified_cutoffs_in_several_strata(spark):
    """kept against a plain run, where several strata certify cutoffs, each its own."""
    rng = random.Random(8)
    rows = []

    def add(lang, count, symbols, capitals, label):
        for _ in range(count):
            w = [f"w{rng.randrange(10**6):06d}" for _ in range(52)]
            rows.append((len(rows), lang, " ".join(w) + " " + "#" * rng.choice(symbols) + " " + "A" * rng.choice(capitals), label))

    add("en", 1700, [0, 4, 8, 12], [0, 1], 1)
    add("de", 1650, [0, 20, 30, 40], [0, 1], 1)
    add("fr", 800, [0, 1], [0, 30, 60], 1)
    add(None, 900, [0, 1], [0, 30, 60], 1)
    for lang in ("en", "de", "fr", None):
        add(lang, 60, [4, 15, 60, 300], [0, 1, 30, 90, 400], 0)
        add(lang, 40, [0, 2, 15, 60, 300], [0, 1, 30, 90, 400], None)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    stratum = lambda lang: lang if lang in ("en", "de") else "*"

    def rates(t):
        chars = sum(map(len, words(t)))
        return {"symbols": 100 * t.count("#") // chars, "capitals": 100 * t.count("A") // chars}

    seen = {i: rates(t) for i, _, t, _ in rows}
    cut = {}
    for s in ("en", "de", "*"):
        for rule in ("symbols", "capitals"):
            held = [(seen[i][rule], q) for i, lang, _, q in rows if stratum(lang) == s and q is not None]
            n, best = sum(q for _, q in held), 0
            cut[s, rule] = 100
            for c in range(99, -1, -1):
                good, bad = (sum(1 for r, q in held if r > c and q == v) for v in (1, 0))
                if upper_is_over(good, n, 0.02 / 5, 0.05 / 15):
                    break
                if bad - 10 * good > best:
                    best, cut[s, rule] = bad - 10 * good, c
    want = {i: all(seen[i][r] <= cut[stratum(lang), r] for r in ("symbols", "capitals")) for i, lang, _, _ in rows}
    assert got == want
    assert len({cut[s, "symbols"] for s in ("en", "de", "*")}) == 3 and max(cut.values()) < 100
    assert 100 < sum(not k for k in want.values()) < 500


def test_tokens_stage(spark, data, docs):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], tuple(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in data)
    got = corpus_pipeline.tokenize(spark, docs, "").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_runs(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count()
    assert np.all([r["n_tokens"] > 0 for r in out.select("n_tokens").collect()])
