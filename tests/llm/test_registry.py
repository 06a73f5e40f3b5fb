"""Registered queries against their SQL ."""

import pytest
from sqlcheck import same

from epochlake.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
