"""What grows with the tables is work in proportion to them: sums before broadcasts, products by blocks."""

import duckdb
import numpy as np

from tensorql import queries
from tensorql.functions import scalar as S
from tensorql.operators.lowering import Lowering, from_numpy, to_numpy
from tensorql.plans import graph as G
from tensorql.plans.autodiff import backprop


def test_sums_before_broadcasts(spark):
    """The gradient of sum(a b^T) by a is the same in each row: its sums are taken once, not once a row."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(20, 3))
    x, y = (G.input_(from_numpy(spark, m), m.shape) for m in (a, b))
    df = Lowering(spark)(backprop(G.contraction("ij,kj->ik", x, y), [x])[0])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Aggregate")
    assert np.allclose(to_numpy(df, (30, 3)), np.tile(b.sum(0), (30, 1)))


def test_one_sum_everywhere(spark):
    """No label of the output is an input's; order of labels; max as well as sums."""
    b = np.arange(6.0).reshape(2, 3)
    y = G.input_(from_numpy(spark, b), b.shape)
    f = S.hole(0)
    assert (to_numpy(Lowering(spark)(G.apply("kj->i", [y], f, "add", {"i": (4,)})), (4,)) == b.sum()).all()
    assert (to_numpy(Lowering(spark)(G.apply("kj->ijm", [y], f, "max", {"i": (4,), "m": (2,)})), (4, 3, 2)) == b.max(0)[None, :, None]).all()
    assert Lowering(spark)(G.apply("kj->i", [G.input_(from_numpy(spark, b).where("false"), b.shape)], f, "add", {"i": (4,)})).count() == 0


def test_products_by_blocks(spark, sf):
    """Weights, attention scores and batched products of many vectors are multiplied by blocks; elementwise products aren't."""
    x, w = G.input_(from_numpy(spark, np.zeros((1, 1))), (40_000, 8, 8)), G.fill(1.0, (8, 8))
    q = G.fill(1.0, (2500, 16, 4, 16))
    low = Lowering(spark)
    for t in (G.matmul(x, w), G.matmul(w, x), G.contraction("bsm,mhd->bshd", G.fill(1.0, (2500, 16, 64)), G.fill(1.0, (64, 4, 16))), G.contraction("bshd,bthd->bhst", q, q)):
        assert low._by_blocks(t.permuted().node)
    assert not low._by_blocks(G.mul(x, x).permuted().node)


def test_a_task_takes_so_many_values(spark, sf, monkeypatch):
    """A file of many vectors is dealt out before its values become rows, and sums of each vector need no other shuffle."""
    monkeypatch.setattr(queries, "TAKEN", 8_000)
    x = queries.x_tensor(spark, sf)
    assert x.node.p["df"].rdd.getNumPartitions() == 4
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    for name in ("matmul_batched_by_2d", "attention_rows"):
        got = queries.QUERIES[name](spark, sf).toPandas().sort_values(["i", "j"] + ["k"] * (name != "attention_rows"), ignore_index=True)
        want = con.sql(queries.SQL[name]).df()[list(got.columns)].sort_values(list(got.columns[:-1]), ignore_index=True)
        assert len(got) == len(want) and np.allclose(got, want, atol=2e-6)


def test_rows_are_filled(spark):
    """The last row of positions has zeros after the last vector, and nothing is joined for that."""
    x = np.arange(1.0, 36.0).reshape(7, 5)
    full = queries.in_rows(spark, G.input_(from_numpy(spark, x), x.shape), 4)
    df = Lowering(spark)(full)
    assert full.shape == (2, 4, 5) and df.count() == 40 and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert (to_numpy(df, (2, 4, 5)).reshape(8, 5) == np.vstack([x, np.zeros((1, 5))])).all()
