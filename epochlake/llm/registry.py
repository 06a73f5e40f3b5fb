"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import bpe, divergence, embeddings, language, mixing, ngram_join, quality, secrets, sharding, substrings, toxicity, url_filters, vector_codes

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_bpe": bpe.op5_bpe,
    "op6_sharding": sharding.op6_sharding,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_embedding_dedup": embeddings.op8_embedding_dedup,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_language_id": language.op12_language_id,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op1_substring_dedup": substrings.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op8_embedding_dedup": embeddings.OP8_SQL,
    "op9_url_filters": url_filters.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
