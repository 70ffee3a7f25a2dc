"""Plans that grow with the graph, formed nodes, blocks chosen by the lowering, sharded files, tokenizers, small helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorql import queries as Q
from tensorql.functions import scalar as S
from tensorql.operators import lowering, nn
from tensorql.operators.lowering import Lowering, from_numpy, to_numpy
from tensorql.operators.topk import top_k
from tensorql.plans import graph as G
from tensorql.plans.autodiff import backprop
from tensorql.plans.spec import Spec
from tensorql.sources import tensors as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def softmax(a):
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(3).standard_normal((6, 5))


def test_plans_grow_with_depth_only(spark, a):
    lines = []
    for depth in (4, 8):
        x = G.input_(from_numpy(spark, a), a.shape)
        want = a
        for _ in range(depth):
            x, want = G.softmax_v1(x) + x, softmax(want) + want
        df = Lowering(spark)(x)
        lines.append(len(plan(df).split("\n")))
        assert "Join" not in plan(df) and plan(df).count("Exchange") == 1
    assert lines[1] < 2.2 * lines[0]
    np.testing.assert_allclose(to_numpy(df, a.shape), want, rtol=1e-12)


def test_joined_chains_are_formed(spark, a):
    """x = (x x^T x) / 8 + x: every step takes the one before three times, by joins."""
    x, want = G.input_(from_numpy(spark, a), a.shape), a
    for _ in range(6):
        x = G.scale(0.125, G.matmul(G.contraction("ij,kj->ik", x, x), x)) + x
        want = (want @ want.T @ want) * 0.125 + want
    df = Lowering(spark)(x)
    assert plan(df).count("Join") < 20
    np.testing.assert_allclose(to_numpy(df, a.shape), want, rtol=1e-9)


def test_long_rows_are_joined(spark, a, monkeypatch):
    monkeypatch.setattr(lowering, "ROW", 4)
    df = Lowering(spark)(G.softmax_v1(G.input_(from_numpy(spark, a), a.shape)))
    assert "Window" not in plan(df)
    np.testing.assert_allclose(to_numpy(df, a.shape), softmax(a), rtol=1e-12)


@pytest.mark.parametrize("spec", ["ij,jk->ik", "ji,jk->ik", "ij,kj->ik", "bij,bjk->bik", "ijk,kl->li"])
def test_blocks(spark, spec, monkeypatch):
    monkeypatch.setattr(lowering, "INTENSITY", 0)
    s = Spec.parse(spec)
    sizes = dict(zip("ijkbl", (37, 41, 29, 3, 5), strict=True))
    rng = np.random.default_rng(1)
    arrays = [rng.standard_normal([sizes[c] for c in t]) for t in s.terms]
    t = G.contraction(spec, *(G.input_(from_numpy(spark, x), x.shape) for x in arrays))
    monkeypatch.setattr(lowering.blocked, "choose_blocks", lambda spec, _: dict.fromkeys(spec.labels, 16))
    by_blocks = Lowering(spark, products=1)(t)
    assert "MapInArrow" in plan(by_blocks) and "MapInArrow" not in plan(Lowering(spark)(t))
    np.testing.assert_allclose(to_numpy(by_blocks, t.shape), np.einsum(spec, *arrays), rtol=1e-9, atol=1e-12)


def test_formation(spark, a):
    x = G.input_(from_numpy(spark, a), a.shape)
    y = G.ew(S.square(), x).formed()
    np.testing.assert_allclose(to_numpy(Lowering(spark)(y), a.shape), a * a)
    np.testing.assert_allclose(to_numpy(Lowering(spark)(backprop(G.mul(y, y), [x])[0]), a.shape), 4 * a**3)
    assert G.formation(x.node) is x.node


def test_top_k_keeps_n_rows_before_the_shuffle(spark, a):
    assert "WindowGroupLimit" in plan(top_k(from_numpy(spark, a).select("d0", "d1", "val"), 2))


def test_helpers():
    assert str(Spec.parse("zx,xy->zy").normalized()) == "ac,cb->ab"
    assert str(Spec.parse("j->ij").without_broadcast()) == "j->j"
    n = G.einsum("ij,jk->ik", [G.constant(1, (2, 3)), G.constant(1, (3, 4))], S.mul(S.hole(0), S.hole(1)), "add")
    assert G.resized(n, [G.constant(1, (5, 6)), G.constant(1, (6, 7))]).shape == (5, 7)
    t = G.lowertri(1.0, 0.0, 9, 9, 1)
    box = G.subset(t, (2, 3), (6, 8))
    assert box.kind == "lowertri" and box.p["start"] == 2 and G.subset(G.constant(4, (5, 5)), (1, 1), (3, 4)).p["value"] == 4
    assert G.subset(t, (0, 5), (2, 9)).kind == "constant"
    assert [f.aggregate_of() for f in (S.from_aggregate("add"), S.from_aggregate("mul"), S.from_aggregate("min"), S.from_aggregate("max"), S.sub())] == ["add", "mul", "min", "max", None]
    assert S.hole().is_identity() and S.constant(2).is_constant() and S.square().is_unary() and S.sub().is_binary() and S.constant(2).is_constant_of(2)
    assert (S.scale(2.5).get_scale(), S.square().get_scale(), S.scale_which(2, 1).get_scale()) == (2.5, None, None)


def test_parts_of_complex_numbers_and_likelihood(spark):
    z = np.array([[1 + 2j, -3j], [0.5, 4 - 1j]], np.complex64)
    x = G.input_(from_numpy(spark, z), z.shape, "c64")
    h = S.hole(0, "c64")
    np.testing.assert_allclose(to_numpy(Lowering(spark)(G.ew(S.imag(h), x)), z.shape, "f32"), z.imag)
    np.testing.assert_allclose(to_numpy(Lowering(spark)(G.ew(S.cplex(S.imag(h), S.real(h)), x)), z.shape, "c64"), z.imag + 1j * z.real)
    p, y = np.array([[0.25, 0.75], [0.5, 0.5]]), np.array([[0.0, 1.0], [1.0, 0.0]])
    got = Lowering(spark)(nn.negative_log_likelihood(G.input_(from_numpy(spark, p), p.shape), G.input_(from_numpy(spark, y), y.shape)))
    np.testing.assert_allclose(to_numpy(got, (1,)), -(y * np.log(p)).sum() / 2)


def test_sharded_weights(spark, tmp_path):
    w, norm = np.arange(24, dtype=np.float16).reshape(4, 6), np.arange(6, dtype=np.float16)
    for k in range(2):
        parts = {"norm": norm + 100 * k, "rows": w[2 * k : 2 * k + 2], "columns": np.ascontiguousarray(w[:, 3 * k : 3 * k + 3])}
        (tmp_path / f"weights.{k}").write_bytes(T.weights_bytes(parts))
    read = lambda *args: to_numpy(T.read_sharded(spark, str(tmp_path), *args), args[1])
    np.testing.assert_array_equal(read("norm", (6,)), norm)
    np.testing.assert_array_equal(read("rows", (4, 6), 0), w)
    np.testing.assert_array_equal(read("columns", (4, 6), 1), w)
    with pytest.raises(ValueError):
        T.read_sharded(spark, str(tmp_path), "rows", (5, 6), 0)


def test_external_tokenizer(spark):
    def make():
        return lambda text: [len(w) for w in text.split()]

    df = spark.createDataFrame([(1, "a bc  def"), (2, None), (3, "")], "k long, t string")
    assert {r["row"]: list(r["ids"]) for r in T.encode_texts(df, "k", "t", make).collect()} == {1: [1, 2, 3], 2: [], 3: []}


def test_gather_and_one_hot_do_not_cross(spark, a):
    ids = spark.createDataFrame([(0, 2), (1, 9), (2, 2), (3, -1)], "d0 int, id int")
    df = T.gather(from_numpy(spark, a), ids, 5)
    want = np.stack([a[2], np.zeros(5), a[2], np.zeros(5)])
    np.testing.assert_array_equal(to_numpy(df, (4, 5)), want)
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_queries_against_their_sql(spark, sf):
    """Models and loops, whose SQL is unrolled."""
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in ("transformer", "train_loop", "decode_loop", "multi_label_loss", "grad_checkpointed", "complex_parts", "fill_select", "formed_twice"):
        got = Q.QUERIES[name](spark, sf).toPandas()
        want = con.sql(Q.SQL[name]).df()[list(got.columns)]
        keys = [c for c in got.columns if c != "v"]
        got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
        np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=2e-6, err_msg=name)


def test_lines_of_many_splits(spark, tmp_path):
    """Rows are numbered by their order in the file, whatever the splits."""
    (tmp_path / "a.txt").write_text("400 5 3\n" + "\n".join(f"{k % 3},{(k + 1) % 3} {k % 5}:{k}.5" for k in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        labels, features = T.read_multi_label(spark, str(tmp_path / "a.txt"))
        assert sorted((r["d0"], r["d1"], r["val"]) for r in features.collect()) == [(k, k % 5, k + 0.5) for k in range(400)]
        assert labels.count() == 800 and T.numbered_lines(spark, str(tmp_path / "a.txt")).rdd.getNumPartitions() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "counts").write_text("1,3,2\n")
    got = {r["label"]: (r["n"], round(r["p"], 6)) for r in T.read_counts(spark, str(tmp_path / "counts"), 4).collect()}
    assert got == {0: (1, 0.25), 1: (3, 0.75), 2: (2, 0.5)}
