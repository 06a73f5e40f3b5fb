"""Every registry query against its SQL, or for rows where SQL can't express it."""

import pytest
from sqlcheck import same

from epochlake.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_flagship_golden(spark):
    rows = {r["size"]: (r["n"], r["mean"], r["se"]) for r in QUERIES["event_locked_z_by_size"](spark, "/root/testdata/sf0.01").collect()}
    assert {k: (n, round(m, 5), round(s, 5)) for k, (n, m, s) in rows.items()} == {1: (116, -1.53382, 0.33566), 2: (105, 0.14046, 0.16519), 3: (92, 2.38855, 0.35497)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
