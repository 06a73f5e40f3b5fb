"""Language identification by string kernels: n-gram presence, Nystrom landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch, chunks, distinct, staged, table, term_array

#: Longest n-gram of the blended spectrum (all lengths from 1 on).
LONGEST = 4
#: Bounds of what is fitted on: training rows (shared evenly by the languages, LEAST_ROWS each at least) and landmarks (the
#: same, LEAST_LANDMARKS each).  Landmarks are texts of LANDMARK_BYTES where a language has such.
MOST_ROWS, LEAST_ROWS = 6_000, 20
LANDMARKS, LEAST_LANDMARKS, LANDMARK_BYTES = 128, 4, (400, 20_000)
#: Ridge as a share of the number of training rows, and eigenvalues of the landmarks' kernel that count as zero.
RIDGE, FLAT = 1e-5, 1e-6
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Texts and n-grams of a block of a matrix product.
TEXTS, GRAMS = 256, 8_192
#: Distinct terms whose n-grams a task keeps at hand.
KEPT_TERMS = 400_000
#: A run of letters, with the marks that combine with them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_MARK = " "


def marked_runs(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, run of each, term of each run): the lower-case letter runs of terms, each with a mark at both ends."""
    runs, owner = [], []
    for i, t in enumerate(terms):
        found = (t,) if t.isascii() else LETTERS.findall(t.lower())
        runs += [f"{_MARK}{r}{_MARK}" for r in found]
        owner += [i] * len(found)
    points = np.frombuffer("".join(runs).encode("utf-32-le"), dtype="<u4")
    return points, np.repeat(np.arange(len(runs)), [len(r) for r in runs]), np.array(owner, dtype=np.int64)


def grams(points: np.ndarray, run: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, code) of the n-grams of 1 to LONGEST characters of each run (a mark alone is none) over the sorted alphabet; an
    n-gram is 16 bits a character.  n-grams with other characters are left out."""
    at = np.searchsorted(alphabet, points)
    at[at == len(alphabet)] = 0
    symbol = np.where(alphabet[at] == points, at + 1, 0).astype(np.uint64) if len(alphabet) else np.zeros(len(points), dtype=np.uint64)
    runs, codes = [], []
    code, ok = np.zeros(len(points), dtype=np.uint64), np.ones(len(points), dtype=bool)
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code, ok = code[:m] | symbol[n - 1 :] << np.uint64(16 * (n - 1)), ok[:m] & (symbol[n - 1 :] > 0) & (run[n - 1 :] == run[:m])
        keep = ok & (points[:m] != ord(_MARK)) if n == 1 else ok
        runs.append(run[:m][keep])
        codes.append(code[keep])
    return (np.concatenate(runs), np.concatenate(codes)) if runs else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


class TermGrams:
    """The known n-grams (positions in codes) of terms, found once a task for each distinct term: at most KEPT_TERMS, then anew.

    start, size and lettered are by number of a term; its n-grams are flat[start : start + size]."""

    def __init__(self, alphabet: np.ndarray, codes: np.ndarray):
        self.alphabet, self.codes, self.number = alphabet, codes, {}
        self.flat, self.start, self.size, self.lettered = (np.zeros(0, dtype=t) for t in ("i4", "i8", "i8", bool))

    def numbers(self, terms: list[str]) -> np.ndarray:
        if len(self.number) > KEPT_TERMS:
            self.__init__(self.alphabet, self.codes)
        new = [t for t in terms if t not in self.number]
        if new:
            n, v = len(new), max(len(self.codes), 1)
            points, run, owner = marked_runs(new)
            run, code = grams(points, run, self.alphabet)
            at = np.searchsorted(self.codes, code)
            at[at == len(self.codes)] = 0
            known = self.codes[at] == code if len(self.codes) else np.zeros(len(at), dtype=bool)
            pairs = distinct(owner[run[known]] * v + at[known])
            first = np.searchsorted(pairs, np.arange(n + 1) * v)
            lettered = np.zeros(n, dtype=bool)
            lettered[owner] = True
            self.start = np.append(self.start, first[:-1] + len(self.flat))
            self.size, self.lettered = np.append(self.size, np.diff(first)), np.append(self.lettered, lettered)
            self.flat = np.append(self.flat, (pairs % v).astype("i4"))
            self.number.update(zip(new, range(len(self.number), len(self.number) + n), strict=True))
        return np.array([self.number[t] for t in terms], dtype=np.int64)


@dataclass
class Landmarks:
    """Landmark texts as presence of n-grams: sorted alphabet and codes, presence [code, landmark], n-grams of each, and the
    map of kernel values to Nystrom features."""

    alphabet: np.ndarray
    codes: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    whiten: np.ndarray
    found: TermGrams | None = field(default=None, repr=False)

    @classmethod
    def of(cls, texts: list[str]) -> Landmarks:
        runs = [marked_runs(terms_of(t)) for t in texts]
        alphabet = np.unique(np.concatenate([r[0] for r in runs]))[:0xFFFF]
        own = [np.unique(grams(points, run, alphabet)[1]) for points, run, _ in runs]
        codes = np.unique(np.concatenate(own))
        presence = np.zeros((len(codes), len(texts)), dtype=np.uint8)
        for k, x in enumerate(own):
            presence[np.searchsorted(codes, x), k] = 1
        sizes = presence.sum(axis=0).astype(np.float64)
        kernel = normalized(presence.T.astype(np.float64) @ presence, sizes, sizes)
        value, vector = np.linalg.eigh(kernel)
        use = value > FLAT
        return cls(alphabet, codes, presence, sizes, vector[:, use] / np.sqrt(value[use]))

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kernel value of each text with each landmark, whether the text has a letter).

        The kernel is the number of n-grams of all lengths that two texts share, over the root of the product of how many
        each has (of a text, those known from any landmark).  A term's n-grams are found once for all texts of the chunk;
        presence is multiplied in blocks."""
        terms, doc = term_array(data, offsets)
        n, d, v = len(offsets) - 1, max(len(terms.dictionary), 1), len(self.codes)
        self.found = self.found or TermGrams(self.alphabet, self.codes)
        number = self.found.numbers(terms.dictionary.to_pylist())
        start, size, flat = self.found.start, self.found.size, self.found.flat
        each = distinct(doc * d + terms.indices.to_numpy().astype(np.int64))  # (text, term)
        text, term = each // d, number[each % d]
        has_letter = np.zeros(n, dtype=bool)
        has_letter[text[self.found.lettered[term]]] = True
        shared, own = np.zeros((n, self.presence.shape[1])), np.zeros(n)
        bounds = np.searchsorted(text, np.arange(0, n + TEXTS, TEXTS))
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            rows = slice(k * TEXTS, min((k + 1) * TEXTS, n))
            if rows.start >= n:
                break
            count = size[term[lo:hi]]
            t = np.repeat(text[lo:hi] - rows.start, count)
            before = np.cumsum(count) - count
            g = flat[np.repeat(start[term[lo:hi]] - before, count) + np.arange(len(t))]
            for a in range(0, v, GRAMS):
                width = min(GRAMS, v - a)
                block = np.zeros((rows.stop - rows.start, width), dtype=np.float32)
                mine = (g >= a) & (g < a + GRAMS) if v > GRAMS else slice(None)
                block.ravel()[t[mine] * width + (g[mine] - a)] = 1
                shared[rows] += block @ self.presence[a : a + GRAMS].astype(np.float32)
                own[rows] += block.sum(axis=1)
        return normalized(shared, own, self.sizes), has_letter


def terms_of(text: str) -> list[str]:
    raw = text.encode()
    return term_array(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0].dictionary.to_pylist()


def normalized(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared / np.sqrt(np.maximum(np.multiply.outer(a, b), 1))


def ridge(features: np.ndarray, lang: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights [feature, language], bias): each language against the rest, targets 1 and -1; rows weigh so that every
    language has the same total."""
    weight = 1 / np.bincount(lang, minlength=langs)[lang]
    weight *= len(lang) / weight.sum()
    target = np.where(lang[:, None] == np.arange(langs), 1.0, -1.0)
    mx, my = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    x, y = features - mx, target - my
    w = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * len(lang) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    return w, my - mx @ w


def _fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(lang, rank, text) of the rows to learn from, written, and the languages: of each language the rows with the least
    hashes of doc_id outside the held-out fold."""
    known = docs.where((_fold() != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    per = max(LEAST_ROWS, MOST_ROWS // max(len(langs), 1))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)
    ids = ids.select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"), "rank")  # at most max(MOST_ROWS, LEAST_ROWS * languages)
    rows = known.join(F.broadcast(ids), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")))
    return staged(rows.groupBy("lang", "rank").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "language-sample"), langs


def train(docs: DataFrame) -> tuple[Landmarks, np.ndarray, np.ndarray, list[str]] | None:
    """(landmarks, weights on kernel values, bias, languages), None where nothing can be learned.

    The driver gets the landmark texts and, of each training row, its kernel values with the landmarks."""
    sample, langs = training_sample(docs)
    if not langs:
        return None
    size = F.octet_length("text")
    usual = F.greatest(F.lit(LANDMARK_BYTES[0]) - size, size - F.lit(LANDMARK_BYTES[1]), F.lit(0))
    order = Window.partitionBy("lang").orderBy(usual, "rank")
    chosen = sample.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(LEAST_LANDMARKS, LANDMARKS // len(langs))).select("lang", "k", "text")
    texts = [t for _, _, t in sorted((r["lang"], r["k"], r["text"]) for r in chosen.collect()) if LETTERS.search(t)]
    if not texts:
        return None
    marks = Landmarks.of(texts)

    def kernels(batches):
        schema = pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("k", pa.binary())])
        for b in batches:
            rows = [r for _, _, data, offsets in chunks(b.column("text")) for r in marks.kernel(data, offsets)[0]]
            yield batch(schema, b.column("lang"), b.column("rank"), [r.tobytes() for r in rows])

    got = sample.mapInArrow(kernels, "lang string, rank int, k binary").collect()
    got = sorted((r["lang"], r["rank"], bytes(r["k"])) for r in got)  # the same sums whatever the task order
    features = np.array([np.frombuffer(k) for _, _, k in got]) @ marks.whiten
    weights, bias = ridge(features, np.array([langs.index(x) for x, _, _ in got]), len(langs))
    return marks, marks.whiten @ weights, bias, langs


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    Presence of the n-grams of whole texts is compared with landmark texts by a normalized kernel; one ridge regression a
    language tells it from the rest, and the greatest value wins (the first language on a tie), its score (value + 1) / 2
    within 0 and 1.  Scoring shuffles nothing; a text's matrix rows are made in blocks, whatever its length.

    Null texts and texts without a letter give UNKNOWN and score 0, as all do where nothing can be learned; texts without
    any known n-gram get the bias; repeated rows score alike; rows with a null doc_id are neither learned from nor held out;
    an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs)
    model = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS texts
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            names, scores = [], []
            for i, j, data, offsets in chunks(b.column("text")):
                if model.value is None:
                    names, scores = names + [UNKNOWN] * (j - i), scores + [0.0] * (j - i)
                    continue
                marks, weights, bias, langs = model.value
                k, lettered = marks.kernel(data, offsets)
                f = k @ weights + bias
                best = f.argmax(axis=1)
                names += [langs[x] if ok else UNKNOWN for x, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), 0.0).tolist()
            yield batch(schema, b.column("doc_id"), b.column("held_out"), names, scores)

    return docs.select("doc_id", F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
