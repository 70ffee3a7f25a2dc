"""Optimizer steps on the tensor graph. A step takes weights, gradients and state, and gives weights and state."""

from __future__ import annotations

from tensorql.functions import scalar as S
from tensorql.plans import graph as G
from tensorql.plans.graph import Tensor


def _h(k: int, d: str) -> S.Scalar:
    return S.hole(k, d)


def sgd(w: Tensor, g: Tensor, rate: float | str) -> Tensor:
    """w - rate * g. A rate that is a name is a variable, bound at each run."""
    d = w.dtype
    return G.ew(S.add(_h(0, d), S.mul(S.constant(-1, d), S.scale_which(rate, 1, d))), w, g)


def momentum(w: Tensor, g: Tensor, v: Tensor, rate: float | str, eta: float = 0.9) -> tuple[Tensor, Tensor]:
    """v = eta * v - rate * g; w = w + v."""
    d = w.dtype
    v = G.ew(S.add(S.scale_which(eta, 0, d), S.mul(S.constant(-1, d), S.scale_which(rate, 1, d))), v, g)
    return w + v, v


def adam(w: Tensor, g: Tensor, m: Tensor, s: Tensor, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, step: int | None = None) -> tuple[Tensor, Tensor, Tensor]:
    """Without weight decay. With step None, the variables beta1_power and beta2_power hold the betas to that power."""
    d = w.dtype
    m = G.ew(S.add(S.scale_which(beta1, 0, d), S.scale_which(1 - beta1, 1, d)), m, g)
    s = G.ew(S.add(S.scale_which(beta2, 0, d), S.mul(S.constant(1 - beta2, d), S.power(_h(1, d), 2))), s, g)
    one, minus = S.constant(1, d), S.constant(-1, d)
    power = lambda k, b: S.variable(f"beta{k}_power", d) if step is None else S.constant(b**step, d)
    unbiased = lambda x, k, b: S.mul(x, S.power(S.add(one, S.mul(minus, power(k, b))), -1))
    below = S.power(S.add(S.power(unbiased(_h(2, d), 2, beta2), 0.5), S.constant(eps, d)), -1)
    move = S.mul(S.constant(-rate, d), S.mul(unbiased(_h(1, d), 1, beta1), below))
    return G.ew(S.add(_h(0, d), move), w, m, s), m, s
