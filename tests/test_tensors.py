"""Tensor programs against numpy; layouts against each other; gradients against differences."""

import numpy as np
import pytest

from tensorql.functions import scalar as S
from tensorql.operators import blocked, nn, optim
from tensorql.operators.lowering import Lowering, from_numpy, run, to_numpy
from tensorql.operators.topk import top_k
from tensorql.plans import graph as G
from tensorql.plans.autodiff import backprop
from tensorql.plans.spec import Spec


def tensor(spark, a, dtype="f64"):
    return G.input_(from_numpy(spark, a), a.shape, dtype)


def value(spark, t, **variables):
    node = t.permuted().node
    return to_numpy(Lowering(spark, variables)(t), node.shape, node.dtype)


@pytest.fixture(scope="module")
def r():
    return np.random.default_rng(1)


def test_matmul_golden(spark):
    a, b = np.arange(8.0, 20).reshape(3, 4), np.arange(100.0, 120).reshape(4, 5)
    got = value(spark, G.matmul(tensor(spark, a), tensor(spark, b)))
    assert got.ravel().tolist() == [4110, 4148, 4186, 4224, 4262, 5830, 5884, 5938, 5992, 6046, 7550, 7620, 7690, 7760, 7830]


@pytest.mark.parametrize("spec", ["ij,jk->ik", "ij,kj->ik", "ji,jk->ki", "bij,bjk->bik", "bij,jk->bik", "ij,ij->ij", "i,j->ij", "ij,j->i", "ij,ik->jk", "ijk,kl->jli"])
def test_contractions(spark, r, spec):
    s = Spec.parse(spec)
    size = dict(i=3, j=4, k=5, l=2, b=2)
    a, b = (r.integers(-5, 6, [size[c] for c in t]).astype(float) for t in s.terms)
    got = value(spark, G.contraction(spec, tensor(spark, a), tensor(spark, b)))
    assert np.array_equal(got, np.einsum(spec, a, b))


def test_reductions(spark, r):
    a = r.integers(1, 5, (3, 4, 2)).astype(float)
    for agg, f in (("add", np.sum), ("mul", np.prod), ("min", np.min), ("max", np.max)):
        assert np.array_equal(value(spark, G.reduction("ijk->j", agg, tensor(spark, a))), f(a, axis=(0, 2)))
    assert value(spark, G.sum_to_unit(tensor(spark, a))).tolist() == [a.sum()]


def test_complex(spark, r):
    z = (r.standard_normal((3, 4)) + 1j * r.standard_normal((3, 4))).astype(np.complex64)
    t = tensor(spark, z, "c64")
    assert np.allclose(value(spark, t * t), z * z, atol=1e-5)
    assert np.allclose(value(spark, G.reduction("ij->i", "mul", t)), z.prod(1), atol=1e-4)
    assert np.allclose(value(spark, G.contraction("ij,kj->ik", t, t)), z @ z.T, atol=1e-4)
    assert np.array_equal(value(spark, t.to_real().to_complex()), z)
    with pytest.raises(ValueError):
        G.reduction("ij->i", "max", t)


def test_shapes(spark, r):
    a = r.standard_normal((4, 6, 5))
    t = tensor(spark, a)
    assert np.array_equal(value(spark, t.transpose(0, 2)), a.transpose(2, 1, 0))
    assert np.array_equal(value(spark, t.subset(-1, slice(1, 4), slice(None))), a[-1, 1:4])
    assert np.array_equal(value(spark, t.subset(2, 3, -2)), a[2, 3, -2:-1])
    assert np.array_equal(value(spark, t.unsqueeze(1)), a[:, None])
    assert np.array_equal(value(spark, G.cat(1, [t, t.subset(slice(None), slice(0, 2), slice(None))])), np.concatenate([a, a[:, :2]], 1))
    assert t.subset(slice(None), slice(None), slice(None)).node is t.node
    assert np.allclose(value(spark, G.reduction("ab->a", "add", t.view((24, 5)))).reshape(24), a.reshape(24, 5).sum(1))
    with pytest.raises(ValueError):
        t.view((8, 15))
    with pytest.raises(ValueError):
        G.select((4, 6, 5), [(t.node, (0, 0, 0), (4, 3, 5), (0, 0, 0))])


def test_fills(spark):
    for start in (-9, -6, -2, 0, 3, 7, 9):
        want = np.where(np.arange(8)[:, None] - start >= np.arange(6)[None, :], 2.0, 5.0)
        assert np.array_equal(value(spark, G.triangle(2, 5, 8, 6, start)), want)
    assert G.triangle(2, 5, 8, 6, -5).node.kind == G.triangle(2, 5, 8, 6, 8).node.kind == "constant"
    assert np.array_equal(value(spark, G.fill(3, (2, 2, 2))), np.full((2, 2, 2), 3.0))


def test_rules():
    for bad in ("ij,jk", "ij,,jk->ik", "ii->i", "ij->ii", "->"):
        with pytest.raises(ValueError):
            Spec.parse(bad)
    with pytest.raises(ValueError):
        Spec.parse("ij,jk->ik").sizes([(3, 4), (1, 5)])
    kinds = {"ij->ij": "identity", "ij->ji": "permutation", "ij->i": "aggregation", "ij,ij->ij": "straight", "bij,bjk->bik": "contraction", "i,j->ij": "outer", "i->ij": "broadcast", "ab,a->ab": "join"}
    assert {k: Spec.parse(k).classify() for k in kinds} == kinds
    with pytest.raises(ValueError):
        G.fill(1, (3, 0))


def test_softmaxes_agree(spark, r):
    a = r.standard_normal((3, 2, 4))
    e = np.exp(a - a.max(-1, keepdims=True))
    for f in (G.softmax_v1, G.softmax_v2, G.softmax_v3):
        assert np.allclose(value(spark, f(tensor(spark, a))), e / e.sum(-1, keepdims=True))
    e = np.exp(0.3 * (a - a.max(-1, keepdims=True)))
    assert np.allclose(value(spark, G.softmax_v3(tensor(spark, a), "alpha"), alpha=0.3), e / e.sum(-1, keepdims=True))


GRADS = {
    "product": lambda x: G.contraction("ij,kj->ik", x, x),
    "softmax": lambda x: G.ew(S.square(), G.softmax_v1(x)),
    "softmax_v3": lambda x: G.ew(S.square(), G.softmax_v3(x, 0.7)),
    "max": lambda x: G.reduction("ij->i", "max", x),
    "min": lambda x: G.ew(S.square(), G.reduction("ij->j", "min", x)),
    "mul": lambda x: G.reduction("ij->i", "mul", x),
    "fan_out": lambda x: x * x + G.exp(x),
    "subset": lambda x: G.cat(0, [G.ew(S.power(S.hole(), 3), x.subset(slice(1, 3), slice(None))), x]),
    "squeeze": lambda x: G.ew(S.square(), x.unsqueeze(1)),
    "broadcast": lambda x: G.ew(S.square(), G.broadcast(3, x)),
    "complex": lambda x: G.ew(S.square("f32"), x.to_f32().to_complex().to_real()).to_f64(),
}


@pytest.mark.parametrize("name", GRADS)
def test_gradients(spark, r, name):
    a = r.standard_normal((3, 4)) + 0.1
    got = value(spark, backprop(GRADS[name](t := tensor(spark, a)), [t])[0])
    h = 1e-2 if name == "complex" else 1e-5
    total = lambda b: float(np.sum(value(spark, GRADS[name](tensor(spark, b)))))
    for place in ((0, 1), (2, 3)):
        step = np.zeros_like(a)
        step[place] = h
        assert got[place] == pytest.approx((total(a + step) - total(a - step)) / (2 * h), rel=1e-2, abs=1e-2)


def test_max_gradient_splits_ties(spark):
    t = tensor(spark, np.array([[1.0, 3.0, 3.0], [2.0, 0.0, 1.0]]))
    assert value(spark, backprop(G.reduction("ij->i", "max", t), [t])[0]).tolist() == [[0, 0.5, 0.5], [1, 0, 0]]
    with pytest.raises(ValueError):
        backprop(tensor(spark, np.ones((1, 2), np.complex64), "c64"), [t])


def test_layout_does_not_matter(spark, r):
    a, b = r.integers(-9, 9, (10, 13)).astype(float), r.integers(-9, 9, (13, 7)).astype(float)
    for i, j, k in ((1, 1, 1), (3, 4, 2), (10, 13, 7), (4, 13, 5)):
        left, right = blocked.to_blocks(from_numpy(spark, a), a.shape, (i, j)), blocked.to_blocks(from_numpy(spark, b), b.shape, (j, k))
        out = blocked.contract("ij,jk->ik", left, right)
        assert np.array_equal(to_numpy(blocked.from_blocks(out), (10, 7)), a @ b)
        assert np.array_equal(to_numpy(blocked.from_blocks(blocked.reblock(left, (4, 5))), a.shape), a)
    assert blocked.spans(100, 3) == [33, 33, 34] and blocked.choose_block((1000, 300), 1 << 12) == (63, 38)


def test_layers(spark, r):
    x, w = r.standard_normal((2, 3, 4)), r.standard_normal(4)
    want = x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-6) * w
    assert np.allclose(value(spark, nn.rms_norm(tensor(spark, x), tensor(spark, w))), want)
    m = [r.standard_normal(s) for s in ((4, 2, 3), (4, 2, 3), (4, 2, 3), (2, 3, 4))]
    weights = nn.AttentionWeights(*(tensor(spark, a) for a in m))
    got, (k, _) = nn.attention(tensor(spark, x), weights, nn.causal_mask(3, "f64"))
    q, kk, v = (np.einsum("bsm,mhd->bshd", x, a) for a in m[:3])
    s = np.einsum("bshd,bthd->bhst", q, kk) + np.where(np.tril(np.ones((3, 3))), 0, -np.inf)
    p = np.exp(s - s.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    assert np.allclose(value(spark, got), np.einsum("bshd,hdm->bsm", np.einsum("bhst,bthd->bshd", p, v), m[3]))
    assert np.allclose(value(spark, k), kk)
    past, _ = nn.attention(tensor(spark, x[:, 2:]), weights, None, None, (tensor(spark, kk[:, :2]), tensor(spark, v[:, :2])))
    assert np.allclose(value(spark, past), value(spark, got)[:, 2:])


def test_transformer_runs(spark, r):
    t = lambda *s: tensor(spark, r.standard_normal(s) * 0.3)
    b = nn.Block(nn.AttentionWeights(t(4, 2, 2), t(4, 2, 2), t(4, 2, 2), t(2, 2, 4)), t(4), t(4), t(4, 6), t(6, 4), t(4, 6))
    logits, kvs = nn.transformer(t(1, 3, 4), [b], t(4), t(4, 5), nn.causal_mask(3, "f64"))
    assert np.isfinite(value(spark, logits)).all() and logits.shape == (1, 5) and len(kvs) == 1


def test_rotary(spark, r):
    x = r.standard_normal((2, 3, 1, 4)).astype(np.float32)
    angle = np.arange(3)[:, None] * 10000.0 ** (-2 * np.arange(2) / 4)
    want = (x[..., ::2] + 1j * x[..., 1::2]) * np.exp(1j * angle)[None, :, None, :]
    got = value(spark, nn.rotary(tensor(spark, x, "f32"), G.input_(nn.rotary_table(spark, 3, 4), (3, 2), "c64")))
    assert np.allclose(got[..., ::2] + 1j * got[..., 1::2], want, atol=1e-5)


def test_optimizers(spark, r):
    w, g, m, s = (r.standard_normal((2, 3)) for _ in range(4))
    s = s**2
    tw, tg, tm, ts = (tensor(spark, a) for a in (w, g, m, s))
    assert np.allclose(value(spark, optim.sgd(tw, tg, "rate"), rate=0.1), w - 0.1 * g)
    assert np.allclose(value(spark, optim.momentum(tw, tg, tm, 0.1)[0]), w + 0.9 * m - 0.1 * g)
    m1, s1 = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
    want = w - 1e-3 * (m1 / (1 - 0.9**3)) / (np.sqrt(s1 / (1 - 0.999**3)) + 1e-8)
    assert np.allclose(value(spark, optim.adam(tw, tg, tm, ts, step=3)[0]), want)
    assert np.allclose(value(spark, optim.adam(tw, tg, tm, ts)[0], beta1_power=0.9**3, beta2_power=0.999**3), want)


def test_saved_and_top(spark, r):
    a = np.array([[1.0, 5, 5, 2], [0, -1, 7, 7]])
    t = tensor(spark, a)
    out = run(spark, {"a": t, "sum": G.reduction("ij->i", "add", t)}, keep=[t.node])
    assert out.keys() == {"a", "sum"} and to_numpy(out["sum"], (2,)).tolist() == [13, 13]
    assert [(x["d0"], x["index"]) for x in top_k(out["a"], 2).orderBy("d0", "place").collect()] == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_aggregation_is_partial_and_projection_is_pushed_down(spark, sf):
    from tensorql import queries

    plan = queries.gram(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
