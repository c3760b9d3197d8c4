"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["t3_resample_business", "w7_rolling_zscore", "c7_walk_forward", "r3_binary_metrics", "b3_b4_performance", "v6_v7_integrated_brier"])
def test_queries_match_sql(spark, name):
    import glob
    import os

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    mine = __spark_entry__.queries()[name](spark, SF)
    theirs = connection.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    key = lambda row: [f"{v:.3f}" if isinstance(v, float) else str(v) for v in row]
    a = sorted([list(r) for r in mine.select(*order).collect()], key=key)
    b = sorted([list(r) for r in theirs.select(*[f'"{c}"' for c in order]).fetchall()], key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=2e-5)) for u, v in zip(x, y, strict=True)), (x, y)
