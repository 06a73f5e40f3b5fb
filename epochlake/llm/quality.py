"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

from math import ceil, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Words, batch, chunks, mix, span_hash, staged, table, window_hash

SYMBOLS = b"#*$%&|<>"
#: Per stratum, at most this share of good documents may be rejected, with this confidence over all strata and rules.
RISK, ERROR = 0.02, 0.05
#: Rules: rates in percent of what the second column counts.
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_upper", "word_chars"), "marks": ("n_marks", "word_chars")}
#: Languages beyond the largest MOST_STRATA are judged together, as are those whose labels cannot certify a cutoff.
MOST_STRATA = 1000
#: A good document rejected outweighs this many bad ones when cutoffs that pass the test are compared.
GOOD_WEIGHT = 10
BASE_WORDS = 50
POOLED = "*"

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def text_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """_FEATURES of whole texts in one buffer."""
    docs = len(offsets) - 1
    w = Words(data, offsets)
    wide = np.zeros(256, dtype=np.uint8)
    wide[list(SYMBOLS)] = 1
    wide[65:91] = 2
    wide[33] = 4
    kind = wide[data]
    lengths = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.bincount(w.doc, weights=lengths[w.ends] - lengths[w.starts], minlength=docs).astype(np.int64) if len(w.doc) else np.zeros(docs, dtype=np.int64)
    # lines
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    starts = starts[starts < len(data)]
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has], ends[has]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    n_lines = np.bincount(owner, minlength=docs)
    key = mix(span_hash(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup_lines = np.bincount(owner[again], minlength=docs)
    # three-word windows
    h = w.hashes()
    n = max(len(h) - 2, 0)
    whole = np.arange(n) + 3 <= w.first[1:][w.doc[:n]]
    at = np.flatnonzero(whole)
    key = mix(window_hash(h, 3)[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 3, dtype=bool)
    for k in range(3):
        cover[at[twice] + k] = True
    repeat = np.diff(np.concatenate([[0], np.cumsum(cover[: len(h)])])[w.first])
    return [w.counts, chars, _sums(kind == 1, offsets), dup_lines, repeat, n_lines, _sums(kind == 2, offsets), _sums(kind == 4, offsets)]


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the features of every row; nulls count as empty texts.  Repeats are found by 64-bit hashes."""
    names = ["doc_id", "lang", *_FEATURES]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in _FEATURES)])

    def run(batches):
        for b in batches:
            yield batch(schema, b.column("doc_id"), b.column("lang"), *_columns(b.column("text")))

    ddl = ", ".join(f"{c} {'string' if c == 'lang' else 'long'}" for c in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, ddl)


def _columns(text: pa.Array) -> list:
    parts = [text_features(data, offsets) for _, _, data, offsets in chunks(text)]
    return [np.concatenate(x).astype("i8") for x in zip(*parts, strict=True)] if parts else [[] for _ in _FEATURES]


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of at most k in n at a share p above k / n.  The k-th term is the largest; the others are
    added downwards, each from the one before, until the rest is lost in rounding: some 9 standard deviations of terms,
    one way for every k and n."""
    term = total = 1.0
    i = k
    while i and term > 1e-17 * total:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) + log(total)


def binomial_upper(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a share of which k in n were seen."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if mid > k / n and log_binomial_tail(k, n, mid) <= log(error) else (mid, hi)
    return hi


def least_good(strata: int, risk: float = RISK, error: float = ERROR) -> int:
    """Good labelled documents from which a stratum of so many can certify a cutoff that rejects none of them."""
    share, error = risk / len(RULES), error / (strata * len(RULES))
    n = max(ceil(log(error) / log1p(-share)), 1)
    return n if binomial_upper(0, n, error) <= share else n + 1


def own_strata(sizes: list[tuple[str, int]], total: int, risk: float = RISK, error: float = ERROR) -> list[str]:
    """The languages judged on their own: as many of the largest as leave every stratum, the pool of all others
    included, least_good() good documents.  Where the others alone fall short, the smallest of the large join them.

    sizes: (language, good labelled documents), largest first; total: those of all languages."""
    for k in range(min(len(sizes), MOST_STRATA), 0, -1):
        pool = total - sum(n for _, n in sizes[:k])
        if min([sizes[k - 1][1], *([pool] if pool else [])]) >= least_good(k + (pool > 0), risk, error):
            return [lang for lang, _ in sizes[:k]]
    return []


def choose_cutoffs(counts: list[tuple[str, str, int, int, int]], risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cutoff in percent; a document is rejected if its rate is above.  100 rejects nothing.

    counts: (stratum, rule, rate in percent, good, bad) over the labelled holdout.  Cutoffs are fixed beforehand, 99
    down to 0.  Each (stratum, rule) is tested in that order and the tests end at the first cutoff whose upper bound on
    the false rejection of good documents is above risk / rules; such an ordered family needs no correction inside, and
    the error is divided by the number of families (Bonferroni); a stratum without good documents is not tested.  So with confidence 1 - error no stratum loses more
    than `risk` of its good documents.  Of the cutoffs that passed, the one with the most bad documents rejected, less
    GOOD_WEIGHT times the good ones, is taken, the most lenient on a tie.
    """
    strata = sorted({s for s, *_ in counts})
    bins: dict[tuple[str, str], np.ndarray] = {(s, r): np.zeros((101, 2), dtype=np.int64) for s in strata for r in RULES}
    for s, r, q, good, bad in counts:
        bins[s, r][min(max(q, 0), 100)] += (good, bad)
    out, families, share = {}, sum(1 for x in bins.values() if x[:, 0].sum()), risk / len(RULES)
    for key, x in bins.items():
        n, best, cutoff = int(x[:, 0].sum()), 0, 100
        above = np.cumsum(x[::-1], axis=0)[::-1]
        for c in range(99, -1, -1):
            good, bad = map(int, above[c + 1])
            # the upper bound is above share: so many or fewer would be seen there too often
            if good >= share * n or log_binomial_tail(good, n, share) > log(error / families):
                break
            if bad - GOOD_WEIGHT * good > best:
                best, cutoff = bad - GOOD_WEIGHT * good, c
        out[key] = cutoff
    return out


def rate(rule: str):
    """Rate of a rule in whole percent, rounded down."""
    a, b = RULES[rule]
    return F.when(F.col(b) > 0, F.least(F.lit(100), F.floor(F.col(a) * 100 / F.col(b)))).otherwise(0).cast("int")


def _base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def certified_cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> tuple[list[str], dict[tuple[str, str], int]]:
    """(languages that are strata of their own, cutoffs by stratum and rule) from all labelled rows that pass the base rules
    (quality 1: good, 0: bad; the least if a doc_id has several).

    Strata are languages; null ones and those with too few good labels to certify a cutoff are pooled (own_strata, from
    numbers of good labels alone).  Only counts by stratum, rule and whole percent reach the driver: at most
    MOST_STRATA * rules * 101.

    Labels of null quality, of null doc_ids or of documents that are not there count for nothing; of a doc_id with several
    rows each counts; languages equal in number of labels come in order of their names; without labels there are no strata
    and every cutoff is 100, which rejects nothing.
    """
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    held = features.where(~_base_failed()).join(known, F.col("doc_id") == F.col("l_id"))
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    large = held.where("lang IS NOT NULL").groupBy("lang").agg(good.alias("good")).where(F.col("good") >= least_good(1, risk, error)).orderBy(F.desc("good"), "lang").limit(MOST_STRATA)
    own = own_strata([tuple(r) for r in large.collect()], held.agg(good).first()[0], risk, error)
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rate(r).alias("q")) for r in RULES])).alias("x")
    counts = held.select(_stratum(own).alias("stratum"), "quality", rates).groupBy("stratum", "x.rule", "x.q").agg(good.alias("good"), bad.alias("bad")).collect()
    return own, choose_cutoffs([tuple(r) for r in counts], risk, error)


def _stratum(own: list[str]) -> Column:
    return F.when(F.col("lang").isin(own), F.col("lang")).otherwise(POOLED) if own else F.lit(POOLED)


def verdict(own: list[str], cutoffs: dict[tuple[str, str], int]) -> Column:
    """Whether a row of features is kept."""
    kept = ~_base_failed()
    for rule in RULES:
        by = {s: c for (s, r), c in cutoffs.items() if r == rule and c < 100}
        if by:
            pairs = F.create_map(*[F.lit(x) for kv in sorted(by.items()) for x in kv])
            kept = kept & (rate(rule) <= F.coalesce(F.element_at(pairs, _stratum(own)), F.lit(100)))
    return kept


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, base features, base_failed and kept of every row of docs (doc_id, text, lang).

    Texts are scanned once, without a shuffle; the small features go to a table in the shared folder, on which the
    cutoffs are certified.

    Null texts have no words and fail the base rules; without labels no cutoff passes and the base rules alone decide;
    rows that repeat a doc_id are judged each by its own text; an empty table gives no rows; other columns are not read.
    """
    f = staged(document_features(docs), "quality-features")
    kept = verdict(*certified_cutoffs(f, labels, risk, error))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that judge keeps, columns unchanged.

    The cutoffs are certified as in judge; then every row is judged by its own text and language in a second scan, so
    null, repeated and clashing ids and columns make no difference and no text is shuffled or joined.
    """
    own, cutoffs = certified_cutoffs(staged(document_features(docs), "quality-features"), labels, risk, error)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = StructType([row.schema["row"], *[StructField(c, LongType()) for c in _FEATURES]])

    def run(batches):
        for b in batches:
            rows = b.column("row")
            found = [pa.array(c, pa.int64()) for c in _columns(rows.field("text"))]
            yield pa.RecordBatch.from_arrays([rows, *found], names=["row", *_FEATURES])

    judged = row.mapInArrow(run, schema).withColumn("lang", F.col("row.lang"))
    return judged.where(verdict(own, cutoffs)).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
