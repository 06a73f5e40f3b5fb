"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, batch, chunks, member, mix, span_hash, staged, table

#: Bounds of the training sample: confirmed toxic rows, and unlabelled rows (least hashes of doc_id first).
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 8_000
#: Words that enter the model: those of at least LEAST_DOCS positives whose share there exceeds the unlabelled one by
#: LEAST_Z standard errors, at most MOST_WORDS of them.
LEAST_DOCS, LEAST_Z, MOST_WORDS = 3, 3.0, 4_096
EPOCHS, RATE, DECAY = 400, 0.1, 1e-7
FOLDS = 5
PREFIX = 4
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(b".,;:!?\"'()[]*#&$%|<>-")] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct word, A-Z lower-cased and without outer punctuation, and of each distinct beginning
    of PREFIX bytes of longer words, which inflected forms share."""
    w = Words(data, offsets, lower=True)
    for _ in range(3):
        more = w.ends - w.starts > 1
        w.ends -= more & _TRIM[w.data[w.ends - 1]]
        more = w.ends - w.starts > 1
        w.starts += more & _TRIM[w.data[w.starts]]
    long = w.ends - w.starts > PREFIX
    start = span_hash(w.data, w.starts[long], w.starts[long] + PREFIX)
    h, d = np.concatenate([w.hashes(), mix(start)]), np.concatenate([w.doc, w.doc[long]])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _sample(batches):
    schema = pa.schema([("positive", pa.bool_()), ("words", pa.binary())])
    for b in batches:
        words = []
        for i, j, data, offsets in chunks(b.column("text")):
            d, h = word_features(data, offsets)
            cut = np.searchsorted(d, np.arange(j - i + 1))
            words += [h[x:y].astype("<u8").tobytes() for x, y in zip(cut, cut[1:], strict=False)]
        yield batch(schema, b.column("positive"), words)


def select_words(sample: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
    """Sorted hashes of the words that enter the model, counted and chosen by Spark; at most MOST_WORDS reach the driver."""

    def single(batches):
        schema = pa.schema([("positive", pa.bool_()), ("word", pa.int64())])
        for b in batches:
            for positive, raw in zip(b.column("positive").to_pylist(), b.column("words").to_pylist(), strict=True):
                w = np.frombuffer(raw, dtype="<i8")
                yield batch(schema, np.full(len(w), positive), w)

    n = sample.mapInArrow(single, "positive boolean, word long").groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    p, q = F.col("a") / F.lit(max(n_pos, 1)), F.col("b") / F.lit(max(n_unl, 1))
    z = (p - q) / F.sqrt(F.greatest(p * (1 - p) / max(n_pos, 1) + (q * (1 - q) + 1e-6) / max(n_unl, 1), F.lit(1e-12)))
    best = n.where(F.col("a") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(MOST_WORDS)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], dtype=np.int64).view(np.uint64))


def nn_risk(w: np.ndarray, b: float, p: tuple, u: tuple, prior: float) -> tuple[float, np.ndarray]:
    """(risk, step direction) of the non-negative positive-unlabelled risk of a linear model with sigmoid loss,
    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) (Kiryo et al., 2017): the gradient, or, where the
    bracket is negative, that of the negated bracket, so that it is ascended.  p and u are (text, word, texts)."""

    def forward(x):
        return np.bincount(x[0], weights=w[x[1]], minlength=x[2]) + b

    def backward(x, g):
        return np.append(np.bincount(x[1], weights=g[x[0]], minlength=len(w)), g.sum())

    sp, su = (1 / (1 + np.exp(-forward(x))) for x in (p, u))
    g_positive = backward(p, prior * sp * (1 - sp) / p[2])
    g_negative = backward(u, su * (1 - su) / u[2]) - g_positive
    bracket = su.mean() - prior * sp.mean()
    return prior * (1 - sp.mean()) + max(0.0, bracket), g_negative - g_positive if bracket >= 0 else -g_negative


def fit_nnpu(words: np.ndarray, pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear model over words that lowers nn_risk, fitted by Adam.  The loss is bounded, so a prior a
    little off moves little.  pos and unl: positions in words of each text's words."""
    if not len(words) or not len(pos) or not len(unl):
        return np.zeros(len(words)), -4.0

    def rows(texts):
        return np.repeat(np.arange(len(texts)), [len(x) for x in texts]), np.concatenate(texts).astype(np.int64), len(texts)

    p, u = rows(pos), rows(unl)
    w, b = np.zeros(len(words)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, EPOCHS + 1):
        g = nn_risk(w, b, p, u, prior)[1]
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]  # words were selected for raising the odds
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample of rows outside the held-out fold; the class prior is the toxic share of its labels.

    The sample's words stay in a table of the shared folder; the driver gets the chosen words and, of each sampled text,
    their positions: at most (MOST_POSITIVE + MOST_UNLABELLED) * MOST_WORDS two-byte numbers, however long texts are."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(fold != 0).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(toxic / n if n else 0.01, 1e-4), 0.5)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.where("toxic = 1").select("doc_id").orderBy(*order).limit(MOST_POSITIVE).withColumn("positive", F.lit(True))
    unl = docs.where(fold != 0).select("doc_id").orderBy(*order).limit(MOST_UNLABELLED).withColumn("positive", F.lit(False))
    chosen = pos.unionByName(unl).select(F.col("doc_id").alias("s_id"), "positive")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select("positive", "text")  # at most MOST_POSITIVE + MOST_UNLABELLED ids
    sample = staged(rows.mapInArrow(_sample, "positive boolean, words binary"), "toxicity-sample")
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    words = select_words(sample, n_pos, n_unl)

    def positions(batches):
        schema = pa.schema([("positive", pa.bool_()), ("at", pa.binary())])
        for b in batches:
            found = [np.flatnonzero(member(words, np.sort(np.frombuffer(x, dtype="<u8")))).astype("<u2").tobytes() for x in b.column("words").to_pylist()]
            yield batch(schema, b.column("positive"), found)

    got = sample.mapInArrow(positions, "positive boolean, at binary").toArrow()
    texts = sorted(zip(got.column("positive").to_pylist(), got.column("at").to_pylist(), strict=True))  # the same sums whatever the task order
    weights, bias = fit_nnpu(words, *([np.frombuffer(x, dtype="<u2") for positive, x in texts if positive is side] for side in (True, False)), prior)
    return words, weights, bias


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Texts are scored in batches against the model, a few thousand word weights; scoring shuffles nothing.  Null and
    empty texts score the bias; without positives the score is constant and low; repeated rows score alike; null doc_ids
    are not held out; an empty table gives no rows; other columns are not read.
    """
    words, weights, bias = train(docs.select("doc_id", "text"), labels)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in batches:
            scores = []
            for i, j, data, offsets in chunks(b.column("text")):
                d, h = word_features(data, offsets)
                z = np.full(j - i, bias)
                if len(words):
                    at = np.searchsorted(words, h)
                    at[at == len(words)] = 0
                    hit = words[at] == h
                    z += np.bincount(d[hit], weights=weights[at[hit]], minlength=j - i)
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield batch(schema, b.column("doc_id"), b.column("held_out"), s, (s >= 0.5).astype("i4"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
