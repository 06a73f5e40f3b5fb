"""BPE encoding and decoding with a contiguous rank array per short word."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import batch, table

#: Words up to this many bytes use the rank array; a quadratic scan would not do for longer ones.
SHORT_WORD = 96
#: Entries of a task's word cache before it is emptied.
CACHE_WORDS = 400_000
#: A merge is the number rank << 20 | merged id; this one stands for none.
NO_MERGE, ID_MASK = 1 << 60, (1 << 20) - 1


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def late_letters() -> str:
    """Code points that `regex` takes for letters or numbers and the installed tokenizer library's older Unicode does
    not, as the ranges of a character class."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    word = regex.compile(r"[\p{L}\p{N}]")
    doubtful = (c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and word.match(chr(c)))
    late = [c for c in doubtful if len(split.pre_tokenize_str(f"a{chr(c)}")) + len(split.pre_tokenize_str(f"1{chr(c)}")) > 3]
    ends = [i for i, c in enumerate(late) if i + 1 == len(late) or late[i + 1] != c + 1]
    return "".join(f"{chr(late[a])}-{chr(late[b])}" for a, b in zip([0, *(i + 1 for i in ends)], ends, strict=False))


class _Cache(dict):
    """Ids of pre-tokens, worked out at their first look-up."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.word = codec.word

    def __missing__(self, text: str) -> bytes:
        self[text] = out = self.word(text)
        return out


class Codec:
    """Encoder and decoder of one tokenizer file (bytes of its JSON)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.byte_id = [vocab[c] for _, c in sorted((b, c) for c, b in alphabet.items())]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        kinds = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(kinds.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
        late = late_letters()
        self.late = re.compile(f"[{late}]") if late else None
        self.may_be_late = re.compile(f"[{late[0]}-\U0010ffff]") if late else None
        self.careful = regex.compile("(?V1)" + kinds.replace("{L}", rf"[\p{{L}}--[{late}]]").replace("{N}", rf"[\p{{N}}--[{late}]]").replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]")) if late else self.pattern
        self.cache = _Cache(self)

    def word(self, text: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        ids = [self.byte_id[b] for b in text.encode()]
        ids = self._by_ranks(ids) if len(ids) <= SHORT_WORD else self._by_heap(ids)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _by_ranks(self, ids: list[int]) -> list[int]:
        """ids[i] is the part at boundary i, best[i] the merge of parts i and i + 1."""
        get, none = self.merge.get, NO_MERGE
        best = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while best:
            least = min(best)
            if least == none:
                break
            i = best.index(least)
            ids[i] = new = least & ID_MASK
            del ids[i + 1], best[i]
            if i < len(best):
                best[i] = get(new << 20 | ids[i + 1], none)
            if i:
                best[i - 1] = get(ids[i - 1] << 20 | new, none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same merges in the same order (rank, then position) for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merge.get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & ID_MASK, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
            for x, y in ((before[i], i), (i, j)):
                if x >= 0 and y < n and (m := self.merge.get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> list[bytes]:
        pattern = self.pattern
        if self.late is not None and not text.isascii() and self.may_be_late.search(text) and self.late.search(text):
            pattern = self.careful
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return list(map(self.cache.__getitem__, pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        if self.split_added is None or not any(x in text for x in self.added):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [np.array([self.added[part]], dtype="<u4").tobytes()] if k % 2 else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; what is no valid UTF-8 becomes U+FFFD."""
        pieces = self.pieces
        raw = b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


def _shipped(spark: SparkSession, path: str | None):
    """The vocabulary, a file of fixed size (1.5 MB), to all tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_CODECS: dict[bytes, Codec] = {}


def codec(raw: bytes) -> Codec:
    key = hashlib.md5(raw).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every whole text; null and empty texts have no ids; null and repeated ids and repeated rows are
    encoded each; an empty table gives no rows; other columns are not read.

    Each batch is handled alone: no shuffle, memory bounded by a batch and CACHE_WORDS.
    """
    shipped = _shipped(docs.sparkSession, path)

    def run(batches):
        c = codec(shipped.value)
        for b in batches:
            ids = [np.frombuffer(c.encode(t.as_py() or ""), dtype="<u4").astype("i4") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS id", "text").mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null and empty ids give an empty text; null and repeated identifiers and repeated rows are
    decoded each; an empty table gives no rows; other columns are not read."""
    shipped = _shipped(encoded.sparkSession, path)

    def run(batches):
        c = codec(shipped.value)
        for b in batches:
            text = [c.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()).decode() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(text, pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.selectExpr(f"`{id_col}` AS id", "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and of the decoded text, in one pass over the texts.

    Null and empty texts have no ids (and the digests of nothing); null and repeated doc_ids and repeated rows are encoded
    each; an empty table gives no rows; other columns are not read.
    """
    shipped = _shipped(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c, sha = codec(shipped.value), hashlib.sha256
        for b in batches:
            rows = []
            for t in b.column("text"):
                ids = c.encode(t.as_py() or "")
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(c.decode(ids)).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch(schema, b.column("doc_id"), list(n), list(a), list(d))

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
