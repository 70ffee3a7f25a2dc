"""Loaders, files and loops."""

import struct

import numpy as np

from tensorql.operators.lowering import from_numpy, grid, to_numpy
from tensorql.sources import tensors as T
from tensorql.streaming.loop import iterate


def test_weights_file(spark, tmp_path):
    a, b = np.arange(6, dtype=np.float16), np.array([0.5, -2], np.float16)
    (tmp_path / "base_00").write_bytes(T.weights_bytes({"layer.a": a, "b": b}))
    got = T.read_weights(spark, str(tmp_path))
    rows = got.where("name = 'layer.a'")
    assert to_numpy(T.flat_to_tensor(rows, (2, 3)), (2, 3)).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert sorted(r["val"] for r in got.where("name = 'b'").collect()) == [-2, 0.5]


def test_records(spark, tmp_path):
    texts = ["one", "", "zwei ü"]
    (tmp_path / "x").write_bytes(b"".join(struct.pack("<i", len(t.encode())) + t.encode() for t in texts))
    assert [r["text"] for r in T.read_records(spark, str(tmp_path)).orderBy("record").collect()] == texts


def test_multi_label(spark, tmp_path):
    (tmp_path / "t.txt").write_text("2 5 3\n0,2 1:0.5 4:2\n1 0:1\n")
    labels, features = T.read_multi_label(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, labels.collect())) == [(0, 0), (0, 2), (1, 1)]
    assert to_numpy(T.densify(features, (2, 5)), (2, 5)).tolist() == [[0, 0.5, 0, 0, 2], [1, 0, 0, 0, 0]]
    weights = {r["label"]: r for r in T.label_weights(labels, 4).collect()}
    assert weights[0]["n"] == 1 and abs(weights[0]["logit"] - np.log(1 / 3)) < 1e-12


def test_nested_text(spark):
    df = spark.createDataFrame([("[[1,2,3],[4,5,6.5]]",)], "t string")
    assert to_numpy(T.parse_nested(df, "t", 2), (2, 3)).tolist() == [[1, 2, 3], [4, 5, 6.5]]


def test_gather_and_one_hot(spark):
    table = from_numpy(spark, np.array([[1.0, 2], [3, 4]]))
    ids = spark.createDataFrame([(0, 1), (1, -1), (2, 0), (3, 9)], "d0 int, id int")
    assert to_numpy(T.gather(table, ids, 2), (4, 2)).tolist() == [[3, 4], [0, 0], [1, 2], [0, 0]]
    labels = spark.createDataFrame([(0, 2), (1, 0)], "r int, l int")
    assert to_numpy(T.one_hot(labels, "r", "l", 3), (2, 3)).tolist() == [[0, 0, 1], [1, 0, 0]]


def test_random_is_a_function_of_seed_and_position(spark):
    a = to_numpy(T.uniform(spark, (40, 50), 3), (40, 50))
    b = to_numpy(T.uniform(spark, (40, 50), 3).repartition(7), (40, 50))
    assert np.array_equal(a, b) and 0 < a.min() and a.max() < 1 and abs(a.mean() - 0.5) < 0.03
    n = to_numpy(T.normal(spark, (40, 50), 4), (40, 50))
    assert abs(n.mean()) < 0.1 and abs(n.std() - 1) < 0.1


def test_next_token_windows(spark):
    tokens = spark.createDataFrame([(1, list(range(10, 30))), (2, [5, 6]), (3, []), (4, [9])], "doc_id long, ids array<int>")
    rows = {r["doc_id"]: r for r in T.next_token_windows(tokens, 4, 1).collect()}
    w = rows[1]["window"]
    assert w == list(range(w[0], w[0] + 4)) and rows[1]["target"] == w[-1] + 1
    assert rows[2]["window"] == [-1, -1, -1, 5] and rows[2]["target"] == 6
    assert 3 not in rows and rows[4]["window"] == [-1] * 4 and rows[4]["target"] == 9


def test_loop(spark):
    from pyspark.sql import functions as F

    start = grid(spark, (3,)).withColumn("val", F.lit(1.0))
    out = iterate(spark, {"x": start}, lambda s, k: {"x": s["x"].withColumn("val", F.col("val") * 2 + k)}, 3)
    assert to_numpy(out["x"], (3,)).tolist() == [12, 12, 12]
    assert "Project" not in out["x"]._jdf.queryExecution().logical().toString()


def test_save_and_load(spark, tmp_path):
    T.save(T.iota(spark, (2, 3), 5), str(tmp_path / "t"))
    assert to_numpy(T.load(spark, str(tmp_path / "t")), (2, 3)).tolist() == [[5, 6, 7], [8, 9, 10]]
