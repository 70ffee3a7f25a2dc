"""Layers and models composed from tensor operations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tensorql.functions import scalar as S
from tensorql.plans import graph as G
from tensorql.plans.graph import Tensor


def rms_norm(x: Tensor, w: Tensor, eps: float = 1e-6) -> Tensor:
    """x * (mean(x^2) + eps)^-0.5 * w over the last dimension; f16 is computed in f32."""
    d = x.dtype
    wide = "f32" if d == "f16" else d
    y = x.to_dtype(wide)
    n, h = G._rows(y)
    mean = G.apply(f"{n}->{h}", [y], S.mul(S.constant(1 / y.shape[-1], wide), S.square(wide)), "add")
    inverse = G.ew(S.power(S.increment(eps, wide), -0.5), mean)
    normed = G.ew(S.mul(S.hole(0, wide), S.hole(1, wide)), y, inverse, spec=f"{n},{h}->{n}").to_dtype(d)
    return G.ew(S.mul(S.hole(0, d), S.hole(1, d)), normed, w, spec=f"{n},{n[-1]}->{n}")


def rotary(x: Tensor, frequencies: Tensor) -> Tensor:
    """x: (batch, position, head, dim) f32; frequencies: (position, dim / 2) c64. Pairs turned by their angle."""
    turned = G.ew(S.mul(S.hole(0, "c64"), S.hole(1, "c64")), x.to_complex(), frequencies, spec="abcd,bd->abcd")
    return turned.to_real()


def rotary_table(spark, positions: int, dim: int, theta: float = 10000.0, start: int = 0, scale: float = 1.0):
    """Rows of exp(i * scale * (start + p) * theta^(-2k / dim)); a scale under 1 interpolates positions."""
    from pyspark.sql import functions as F

    from tensorql.operators.lowering import grid

    angle = (F.col("d0") + start) * scale * F.pow(F.lit(theta), -2.0 * F.col("d1") / dim)
    return grid(spark, (positions, dim // 2)).withColumn("val", F.struct(F.cos(angle).cast("float").alias("re"), F.sin(angle).cast("float").alias("im")))


def causal_mask(n: int, dtype: str = "f32") -> Tensor:
    """0 on and below the diagonal, -inf above."""
    return G.triangle(0.0, -math.inf, n, n, 0, dtype)


@dataclass(frozen=True)
class AttentionWeights:
    """(model, heads, dim) each; out (heads, dim, model)."""

    q: Tensor
    k: Tensor
    v: Tensor
    out: Tensor


def attention(x: Tensor, w: AttentionWeights, mask: Tensor | None = None, frequencies: Tensor | None = None, past: tuple[Tensor, Tensor] | None = None, scaled: bool = False) -> tuple[Tensor, tuple[Tensor, Tensor]]:
    """x: (batch, position, model). The result and the keys and values, for the next call's past.

    Scores are not divided by sqrt(dim) unless scaled is set.
    """
    project = lambda m: G.contraction("bsm,mhd->bshd", x, m)
    q, k, v = project(w.q), project(w.k), project(w.v)
    if frequencies is not None:
        q, k = rotary(q, frequencies), rotary(k, frequencies)
    if past is not None:
        k, v = G.cat(1, [past[0], k]), G.cat(1, [past[1], v])
    scores = G.contraction("bshd,bthd->bhst", q, k)
    if scaled:
        scores = G.scale(1 / math.sqrt(q.shape[-1]), scores)
    if mask is not None:
        d = scores.dtype
        scores = G.ew(S.add(S.hole(0, d), S.hole(1, d)), scores, mask, spec="bhst,st->bhst")
    mixed = G.contraction("bhst,bthd->bshd", G.softmax_v1(scores), v)
    return G.contraction("bshd,hdm->bsm", mixed, w.out), (k, v)


def feed_forward(x: Tensor, w1: Tensor, w2: Tensor, w3: Tensor) -> Tensor:
    """(silu(x w1) * (x w3)) w2; x: (batch, position, model), w1 and w3 (model, hidden), w2 (hidden, model)."""
    d = x.dtype
    a, b = G.contraction("bsm,mh->bsh", x, w1), G.contraction("bsm,mh->bsh", x, w3)
    return G.contraction("bsh,hm->bsm", G.ew(S.mul(S.silu(d), S.hole(1, d)), a, b), w2)


@dataclass(frozen=True)
class Block:
    attention: AttentionWeights
    norm1: Tensor
    norm2: Tensor
    w1: Tensor
    w2: Tensor
    w3: Tensor


def block(x: Tensor, w: Block, mask=None, frequencies=None, past=None) -> tuple[Tensor, tuple[Tensor, Tensor]]:
    """A residual block: norm, attention, norm, gated feed-forward."""
    mixed, kv = attention(rms_norm(x, w.norm1), w.attention, mask, frequencies, past)
    x = x + mixed
    return x + feed_forward(rms_norm(x, w.norm2), w.w1, w.w2, w.w3), kv


def transformer(x: Tensor, blocks: list[Block], norm: Tensor, vocabulary: Tensor, mask=None, frequencies=None, pasts=None) -> tuple[Tensor, list]:
    """Logits (batch, vocabulary) of the last position; keys and values of each block."""
    kvs = []
    for k, w in enumerate(blocks):
        x, kv = block(x, w, mask, frequencies, pasts[k] if pasts else None)
        kvs.append(kv)
    last = rms_norm(x, norm).subset(slice(None), -1, slice(None))
    return G.contraction("bm,mv->bv", last, vocabulary), kvs


def lora_matmul(x: Tensor, w: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """x w + (x a) b."""
    return G.matmul(x, w) + G.matmul(G.matmul(x, a), b)


def negative_log_likelihood(probabilities: Tensor, targets: Tensor) -> Tensor:
    """-sum(target * log p) / rows, of shape [1]."""
    d = probabilities.dtype
    n = probabilities.shape[0]
    f = S.mul(S.mul(S.constant(-1 / n, d), S.hole(1, d)), S.log(S.hole(0, d)))
    return G.sum_to_unit(G.ew(f, probabilities, targets))


def squared_error(x: Tensor, y: Tensor) -> Tensor:
    """Sum of squares of differences, of shape [1]."""
    d = x.dtype
    return G.sum_to_unit(G.ew(S.square(d).replace({0: S.sub(d)}), x, y))


def relu_network(x: Tensor, weights: list[Tensor], formed: bool = False) -> Tensor:
    """x (row, feature) through linear layers, with relu after each but the last. With formed, each layer's result is a checkpoint: written once, for the gradient too."""
    for w in weights[:-1]:
        x = G.ew(S.relu(x.dtype), G.matmul(x, w))
        x = x.formed() if formed else x
    return G.matmul(x, weights[-1])


def mean_squared_error(x: Tensor, y: Tensor) -> Tensor:
    """Mean of squares of differences over all values, of shape [1]."""
    return G.scale(1 / math.prod(x.shape), squared_error(x, y))


def multi_label(x: Tensor, hidden: list[tuple[Tensor, Tensor]], out: Tensor, mean_logits: Tensor) -> Tensor:
    """Probabilities (row, label): silu layers, each with its norm's weight, then the sigmoid of a linear layer added to the labels' mean logits."""
    d = x.dtype
    for w, norm in hidden:
        x = rms_norm(G.ew(S.silu(d), G.matmul(x, w)), norm)
    logits = G.ew(S.add(S.hole(0, d), S.hole(1, d)), G.matmul(x, out), mean_logits, spec="bl,l->bl")
    return G.ew(S.sigmoid(d), logits)


def sampled_error(probabilities: Tensor, y: Tensor, sampling: Tensor) -> Tensor:
    """Mean of squares of differences, each times its label's weight, of shape [1]."""
    d = probabilities.dtype
    square = S.square(d).replace({0: S.sub(d)})
    weighted = G.ew(S.mul(square, S.hole(2, d)), probabilities, y, sampling, spec="bl,bl,l->bl")
    return G.scale(1 / math.prod(probabilities.shape), G.sum_to_unit(weighted))


def weight_penalty(weights: list[Tensor], rate: float) -> Tensor:
    """rate times the mean square of all weights, of shape [1]."""
    total = None
    for w in weights:
        part = G.sum_to_unit(G.ew(S.square(w.dtype), w))
        total = part if total is None else total + part
    return G.scale(rate / sum(math.prod(w.shape) for w in weights), total)
