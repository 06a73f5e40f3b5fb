"""Corpus pipeline: documents to token ids, in five written stages.

quality rules -> near duplicates -> secrets redacted -> sources mixed -> tokens.  Every stage works on all rows its
predecessor wrote; all but the last return the columns of documents.  Rows are decided one by one, never by doc_id alone:
null and repeated ids, repeated rows, empty tables and further columns of any name are handled by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.llm import bpe, mixing, ngram_join, quality, secrets
from epochlake.llm.shared import staged, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the quality rules reject; cutoffs are certified on the labels of these documents."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, the one with the least doc_id."""
    return ngram_join.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with the secrets found in it replaced; n_chars follows the text."""
    return secrets.redacted_documents(docs, secrets.new_ledger(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often and as long as the mix takes them."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row; null texts have none."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("tokens", tokenize)]

#: Similarity at this scale, fitted cutoffs and tokens are beyond SQL; tests/llm/test_corpus.py runs all five stages
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
