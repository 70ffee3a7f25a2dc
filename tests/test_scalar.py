"""The scalar language: text form, simplification, derivatives, columns."""

import math
import operator

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorql.functions import scalar as S

COMPARE = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "==": operator.eq}


def value(s, *args):
    """A plain evaluator of real trees: numpy's arithmetic, nothing of the library's."""
    a = [value(x, *args) for x in s.args]
    with np.errstate(all="ignore"):
        match s.op:
            case "constant":
                return np.float64(s.payload)
            case "hole":
                return np.float64(args[s.payload])
            case "convert":
                return a[0]
            case "add":
                return a[0] + a[1]
            case "mul":
                return a[0] * a[1]
            case "exp":
                return np.exp(a[0])
            case "log":
                return np.log(a[0])
            case "power":
                return np.power(a[0], np.float64(s.payload))
            case "ite":
                return a[2] if COMPARE[s.payload](a[0], a[1]) else a[3]
    raise NotImplementedError(s.op)


def trees(depth):
    leaf = st.one_of(st.floats(-2, 2).map(S.constant), st.sampled_from([S.hole(0), S.hole(1)]))
    if depth == 0:
        return leaf
    sub = trees(depth - 1)
    return st.one_of(
        leaf,
        st.builds(S.add, sub, sub),
        st.builds(S.mul, sub, sub),
        sub.map(lambda x: S.exp(S.mul(S.constant(0.1), x))),
        sub.map(lambda x: S.power(x, 2)),
        st.builds(lambda a, b, c, d: S.ite("<", a, b, c, d), sub, sub, sub, sub),
    )


@settings(max_examples=200, deadline=None)
@given(trees(3))
def test_text_round_trip(s):
    assert S.parse(str(s)) == s


@settings(max_examples=200, deadline=None)
@given(trees(3), st.floats(-1.5, 1.5), st.floats(-1.5, 1.5))
def test_derivative(s, x, y):
    f, h = lambda v: value(s, v, y), 1e-6
    try:
        slope, left, right = (f(x + h) - f(x - h)) / (2 * h), (f(x) - f(x - h)) / h, (f(x + h) - f(x)) / h
    except OverflowError:
        return
    if not np.isfinite([slope, left, right]).all() or abs(left - right) > 1e-3 * (1 + abs(slope)) or abs(slope) > 1e4:
        return  # a corner of an ite, or too steep for differences
    assert value(S.derivative(s, 0), x, y) == pytest.approx(slope, rel=1e-3, abs=1e-3)


def test_simplify():
    x = S.hole(0)
    assert S.add(x, S.constant(0)) == x == S.mul(S.constant(1), x) == S.power(x, 1)
    assert S.power(x, 0) == S.constant(1)
    assert S.mul(S.constant(2), S.mul(S.constant(3), x)) == S.mul(S.constant(6), x)
    assert S.ite("<", x, S.hole(1), x, x) == x
    assert S.mul(S.constant(0), x) != S.constant(0)  # would hide NaN
    assert S.conj(S.conj(S.hole(0, "c64"))) == S.hole(0, "c64")


def test_types():
    with pytest.raises(ValueError):
        S.add(S.hole(0, "f32"), S.hole(1, "f64"))
    with pytest.raises(ValueError):
        S.exp(S.hole(0, "c64"))
    with pytest.raises(ValueError):
        S.convert(S.hole(0, "c64"), "f32")
    with pytest.raises(ValueError):
        S.parse("+[hole|f64@0")
    assert S.convert(S.hole(0, "f32"), "f32") == S.hole(0, "f32")


def test_combine():
    assert S.combine(S.sub(), [S.mul(S.hole(0), S.hole(1)), S.hole(0)]).holes() == {0, 1, 2}
    assert S.sub().replace({0: S.hole(0), 1: S.hole(0)}).holes() == {0}


def test_columns_follow_ieee(spark):
    rows = [(0.0, 1.0), (-2.0, 0.0), (3.0, 3.0), (math.nan, 1.0), (math.inf, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    made = {
        "log": S.log(S.hole(0)), "inv": S.inverse(), "lt": S.mask("<"), "eq": S.mask("=="), "relu": S.relu(), "drelu": S.relu_deriv(), "div": S.div(), "max": S.maximum(),
    }
    got = df.select(*(S.to_column(s, [F.col("x"), F.col("y")]).alias(k) for k, s in made.items())).collect()
    assert got[0]["log"] == -math.inf and math.isnan(got[1]["log"]) and got[0]["inv"] == math.inf
    assert [r["lt"] for r in got] == [1, 0 + (-2 < 0), 0, 0, 0] and [r["eq"] for r in got] == [0, 0, 1, 0, 0]
    assert got[0]["drelu"] == 0 and got[2]["drelu"] == 1 and got[1]["relu"] == 0
    assert got[1]["div"] == -math.inf and got[2]["div"] == 1


def test_wirtinger():
    z, w = S.hole(0, "c64"), S.hole(1, "c64")
    assert S.wirtinger(S.mul(z, w), 0)[0] == w
    assert S.wirtinger(S.mul(w, S.conj(z)), 0) == (S.constant(0, "c64"), w)
    with pytest.raises(ValueError):
        S.derivative(S.real(z), 0)


def test_columns_of_random_trees(spark):
    """Trees of all operators, drawn once, as columns against the plain evaluator."""
    rng = np.random.default_rng(8)

    def tree(depth):
        k = rng.integers(0, 9) if depth else rng.integers(0, 2)
        sub = lambda: tree(depth - 1)
        match k:
            case 0:
                return S.constant(round(float(rng.uniform(-2, 2)), 2))
            case 1:
                return S.hole(int(rng.integers(0, 2)))
            case 2:
                return S.add(sub(), sub())
            case 3:
                return S.mul(sub(), sub())
            case 4:
                return S.exp(S.mul(S.constant(0.1), sub()))
            case 5:
                return S.log(sub())
            case 6:
                return S.power(sub(), float(rng.choice([2, 3, -1, 0.5])))
            case 7:
                return S.convert(sub(), "f64")
        return S.ite(str(rng.choice(list(COMPARE))), sub(), sub(), sub(), sub())

    made = [tree(3) for _ in range(60)]
    rows = [(float(x), float(y)) for x in (-1.5, 0.0, 0.5, 2.0) for y in (-1.0, 0.0, 3.0)] + [(math.nan, 1.0), (math.inf, -math.inf)]
    df = spark.createDataFrame(rows, "x double, y double").coalesce(1)
    got = df.select("x", "y", *(S.to_column(s, [F.col("x"), F.col("y")]).cast("double").alias(f"t{k}") for k, s in enumerate(made))).collect()
    for r in got:
        want = [value(s, r["x"], r["y"]) for s in made]
        np.testing.assert_allclose([r[f"t{k}"] for k in range(len(made))], want, rtol=1e-9, err_msg=str((r["x"], r["y"])))
