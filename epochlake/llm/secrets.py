"""Secret scans over a content-addressed ledger of text versions."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .shared import batch, plain_rows, shared_dir, staged, table

#: Contract patterns (fixed values): kind, pattern, group judged, least length.
KINDS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Kinds that this operator adds to those of the contract: headers of private keys and signed web tokens.
MORE_KINDS = [
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
FLAGS = {"assign": re.ASCII | re.IGNORECASE}
#: Text without which a kind cannot match, and a pattern for `assign`.
HINTS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ"}
ASSIGN_HINT = r"passw|secret|token|api_?key"
#: Patterns that find the same matches at less cost: a run of 24 hex digits is the shortest that can pass, and runs are maximal.
FASTER = {"hex": r"[0-9a-f]{24,}"}

#: A change of anything that decides what is found makes every blob unseen again.
RULE_VERSION = hashlib.sha256(repr((KINDS + MORE_KINDS, {k: int(v) for k, v in FLAGS.items()}, HINTS, ASSIGN_HINT, FASTER)).encode()).hexdigest()[:16]

ENTRY = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base string, spans string"
VERSION = "path string, blob string"
#: Unseen blobs of a run up to which their list is broadcast (about 100 bytes each).
MOST_SENT = 500_000


def finder():
    """text -> [(start, kind order, kind, end)] in code points, leftmost and non-overlapping per kind."""
    hinted = re.compile(ASSIGN_HINT, re.ASCII | re.IGNORECASE)
    compiled = [(k, kind, re.compile(FASTER.get(kind, pattern), FLAGS.get(kind, re.ASCII)), group, least) for k, (kind, pattern, group, least) in enumerate(KINDS + MORE_KINDS)]

    def find(text: str) -> list[tuple[int, int, str, int]]:
        out = []
        for k, kind, pattern, group, least in compiled:
            if kind == "assign" and not hinted.search(text) or HINTS.get(kind, "") not in text:
                continue
            out += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return sorted(out)

    return find


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def _scan(batches):
    find = finder()
    schema = pa.schema([("blob", pa.string()), ("rule_version", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])
    for b in batches:
        texts, blobs = b.column("text"), b.column("blob").to_pylist()
        hits = [find(t.as_py() or "") for t in texts]
        count = [[sum(x[2] == kind for x in h) for h in hits] for kind, *_ in KINDS]
        base = [_joined([x for x in h if x[1] < len(KINDS)]) for h in hits]
        yield batch(schema, blobs, [RULE_VERSION] * len(blobs), *count, base, [_joined(h) for h in hits])


def _blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob")


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table of the ledger, None before its first run."""
    try:
        return spark.read.schema(f"{schema}, run string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_ledger(docs: DataFrame, folder: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings of every row: id, blob, n_*, base, spans; ledger entries that this run added).

    folder holds the ledger over all runs: folder/ledger, one row per blob and rule version that was scanned, and
    folder/versions, the path and blob of every version a path has had.  Rows of docs are versions of paths, as many of a
    path as it has.  Each text is addressed by its SHA-256; a blob is scanned only if (blob, rule version) is not in the
    ledger, once however many paths hold it, and its findings are joined back to all paths.  Each run appends a partition of
    its own, committed with its job; an entry depends on blob and rule version alone, so a run that was lost or came twice
    costs scans, not results.

    One text a blob is scanned: equal texts are merged in their tasks before they are exchanged by blob, so copies cost what
    one does.  Over a ledger that has entries, only unseen blobs' texts are taken; the list of these is broadcast up to
    MOST_SENT blobs, beyond which it is joined after the merge.  Only blobs with findings take part in the last join, whose
    hot blobs adaptive execution may split.

    Null texts count as empty; repeated rows and repeated or null ids with different texts each keep their own findings; an
    empty table gives no rows; other columns are not read.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    known = _known(spark, f"{folder}/ledger", ENTRY)
    seen = _known(spark, f"{folder}/versions", VERSION)
    paths = staged(docs.select(F.col(id_col).alias("path"), _blob()), "secret-paths")
    texts = docs.select("text", _blob())
    once = lambda t: t.groupBy("blob").agg(F.first("text").alias("text"))
    if known is None:
        picked = once(texts)
    else:
        seen_blobs = known.where(F.col("rule_version") == RULE_VERSION).select("blob")
        todo = staged(paths.select("blob").distinct().join(seen_blobs, "blob", "left_anti"), "secret-todo")
        few = todo.count() <= MOST_SENT
        picked = once(texts.join(F.broadcast(todo), "blob", "left_semi")) if few else once(texts).join(todo, "blob", "left_semi")
    picked.mapInArrow(_scan, ENTRY).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/ledger")
    new = paths.withColumn("path", F.col("path").cast("string"))
    if seen is not None:
        old = seen.select(F.col("path").alias("s_path"), F.col("blob").alias("s_blob"))
        new = new.join(old, F.col("path").eqNullSafe(F.col("s_path")) & (F.col("blob") == F.col("s_blob")), "left_anti")
    new.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{folder}/versions")
    found = _known(spark, f"{folder}/ledger", ENTRY)
    if found is None:  # no blob was ever scanned
        found = spark.createDataFrame([], f"{ENTRY}, run string")
    hits = found.where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != "")).drop("rule_version", "run").dropDuplicates(["blob"])
    back = paths.join(hits, "blob", "left").fillna(0, ["n_assign", "n_access", "n_hex"]).fillna("", ["base", "spans"])
    return back.withColumnRenamed("path", id_col), found.where(F.col("run") == run).drop("run")


def historic_findings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, blob, rule_version, spans) of every version of every path the ledger has seen, under the rules it was scanned by.

    Null paths are one path; a version that came several times is one row; blobs without findings have empty spans; a folder
    that no run has written to gives no rows."""
    versions, ledger = _known(spark, f"{folder}/versions", VERSION), _known(spark, f"{folder}/ledger", ENTRY)
    if versions is None or ledger is None:
        return spark.createDataFrame([], "path string, blob string, rule_version string, spans string")
    entries = ledger.select("blob", "rule_version", "spans").dropDuplicates(["blob", "rule_version"])
    return versions.select("path", "blob").distinct().join(entries, "blob").select("path", "blob", "rule_version", "spans")


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"


@F.pandas_udf(StringType())
def _redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s or "") for t, s in zip(text, spans, strict=True)], dtype=object)


def redacted_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Every row of docs, with the spans found in its text replaced; n_chars follows the text, other columns are unchanged.

    Rows are matched by doc_id (null too) and text, so repeated and null ids make no difference; null texts stay null.  Only
    texts with findings pass through Python.
    """
    found, _ = scan_ledger(docs, folder)
    hits = found.where("spans <> ''").select(F.col("doc_id").alias("h_id"), F.col("blob").alias("h_blob"), "spans").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col("doc_id").alias("d_id"), _blob().alias("d_blob"))
    d = d.join(hits, F.col("d_id").eqNullSafe(F.col("h_id")) & (F.col("d_blob") == F.col("h_blob")), "left").select("row", "spans")
    d = d.withColumn("clean", _redacted(F.when(F.col("spans").isNotNull(), F.col("row.text")), "spans"))
    same = F.col("spans").isNull()
    new = {"text": F.when(same, F.col("row.text")).otherwise(F.col("clean"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return plain_rows(d, docs.columns, **new)


def redact(text: str | None, spans: str, mark: str = "[REDACTED]") -> str | None:
    """text with every span replaced; overlapping spans are merged first."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for s, e in sorted((int(x), int(y)) for _, x, y in (p.split(":") for p in spans.split(","))):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a new ledger, so every blob of the table is scanned."""
    back, _ = scan_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), new_ledger(spark))
    return back.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
