"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tensorql import queries as base


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "v"] and df.count() == 64 * 64


def test_every_query_has_sql():
    assert set(base.QUERIES) == set(base.SQL)


@pytest.mark.parametrize("name", ["gram", "matmul_tt", "reduce_mul", "softmax_v3", "general_select", "rotary", "grad_max", "rmsnorm", "adam_step", "gather", "blocked_matmul", "topk"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "embeddings", "documents", "part", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = base.QUERIES[name](spark, sf).toPandas()
    want = con.sql(base.SQL[name]).df()[list(got.columns)]
    key = lambda df: sorted(df.itertuples(index=False, name=None))
    assert len(got) == len(want)
    for a, b in zip(key(got), key(want), strict=True):
        assert a == pytest.approx(b, abs=2e-4 if name == "rotary" else 2e-6)
