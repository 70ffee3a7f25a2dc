"""Reverse-mode gradients: rewrites on the tensor graph.

The gradient is that of the sum of the output's values. Gradients that are one constant
everywhere stay symbolic fills until something needs their rows.
"""

from __future__ import annotations

from math import prod

from tensorql.functions import scalar as S
from tensorql.plans import graph as G
from tensorql.plans.graph import Node, Tensor
from tensorql.plans.spec import Spec


def _order(out: Node) -> list[Node]:
    seen, order = set(), []

    def go(n: Node) -> None:
        if id(n) not in seen:
            seen.add(id(n))
            for x in n.inputs:
                go(x)
            order.append(n)

    go(out)
    return order


def _sum(grads: list[Node]) -> Node:
    """A tree of pairwise sums; constants are summed as numbers."""
    fixed = [g for g in grads if g.kind == "constant"]
    rest = [g for g in grads if g.kind != "constant"]
    names = G.LETTERS[: len(grads[0].shape)]
    d = grads[0].dtype
    total = sum(g.p["value"] for g in fixed)
    if not rest:
        return G.constant(total, grads[0].shape, d)
    while len(rest) > 1:
        rest = [
            G.einsum(f"{names},{names}->{names}", rest[k : k + 2], S.add(S.hole(0, d), S.hole(1, d))) if k + 1 < len(rest) else rest[k]
            for k in range(0, len(rest), 2)
        ]
    return G.einsum(f"{names}->{names}", rest, S.add(S.hole(0, d), S.constant(total, d))) if total else rest[0]


def _joined(f: S.Scalar, inputs: list[Node], terms: list[str], out: str, sizes: dict[str, int]) -> Node:
    """out = sum of f over all labels that aren't in out, over the whole join shape; inputs that f doesn't use drop out."""
    used = sorted(f.holes())
    d = f.dtype
    have = {c for i in used for c in terms[i]}
    copies = prod(n for c, n in sizes.items() if c not in have and c not in out)  # sums over labels that nothing left depends on
    shape = tuple(sizes[c] for c in out)
    if f.op == "constant":
        return G.constant(f.payload * copies * 1.0, shape, d)
    f = f.replace({i: S.hole(k, f.hole_dtypes()[i]) for k, i in enumerate(used)})
    if copies != 1:
        f = S.mul(S.constant(copies, d), f)
    return G.einsum(Spec(tuple(terms[i] for i in used), out), [inputs[i] for i in used], f, "add", shape)


def _einsum(node: Node, u: Node, wanted: set[int]) -> list[Node | None]:
    spec, join, agg, sizes = node.p["spec"], node.p["join"], node.p["agg"], node.p["sizes"]
    n, d, out = len(node.inputs), node.dtype, []
    constant_u = u.p["value"] if u.kind == "constant" else None
    for i, (x, term) in enumerate(zip(node.inputs, spec.terms, strict=True)):
        if id(x) not in wanted:
            out.append(None)
            continue
        inputs, terms = [*node.inputs, u], [*spec.terms, spec.out]
        up = S.constant(constant_u, d) if constant_u is not None else S.hole(n, d)
        if agg in ("min", "max"):
            if n > 1 or join.op != "hole":
                raise ValueError("gradients of min and max are of plain reductions")
            y = node  # ties share equally
            same = S.is_equal(d)
            ties = G.einsum(Spec((term, spec.out), spec.out), [x, y], same, "add")
            part = S.mul(S.mul(same, S.power(S.hole(2, d), -1)), S.constant(constant_u, d) if constant_u is not None else S.hole(3, d))
            out.append(_joined(part, [x, y, ties, u], [term, spec.out, spec.out, spec.out], term, sizes))
            continue
        if agg == "mul":
            if n > 1 or join.op != "hole":
                raise ValueError("gradients of products are of plain reductions")
            part = S.mul(S.mul(S.hole(1, d), S.power(S.hole(0, d), -1)), S.constant(constant_u, d) if constant_u is not None else S.hole(2, d))
            out.append(_joined(part, [x, node, u], [term, spec.out, spec.out], term, sizes))
            continue
        if d == S.COMPLEX or x.dtype == S.COMPLEX:
            z, zc = S.wirtinger(join, i)
            if zc != S.constant(0, S.COMPLEX):
                raise ValueError("gradients of conjugates of the argument aren't supported")
            f = S.mul(up, S.conj(z)) if z.op != "constant" else S.mul(up, z)
        else:
            f = S.derivative(join, i)
            if x.dtype != d:
                f, up = S.convert(f, x.dtype), S.convert(up, x.dtype)
            f = S.constant(0, x.dtype) if f == S.constant(0, x.dtype) else S.mul(up, f)
        out.append(_joined(f, inputs, terms, term, sizes))
    return out


def backprop(out: Node | Tensor, weights: list[Node | Tensor]) -> list[Tensor]:
    """Gradients of the sum of out's values by each weight, of the weights' nodes' shapes."""
    out = out.node if isinstance(out, Tensor) else out
    nodes = [w.node if isinstance(w, Tensor) else w for w in weights]
    if out.dtype == S.COMPLEX:
        raise ValueError("the output of a gradient is real")
    order = _order(out)
    between = {id(w) for w in nodes}
    for n in order:
        if any(id(x) in between for x in n.inputs):
            between.add(id(n))
    grads: dict[int, list[Node]] = {id(out): [G.constant(1.0, out.shape, out.dtype)]}
    done: dict[int, Node] = {}
    for n in reversed(order):
        if id(n) not in between or id(n) not in grads:
            continue
        u = done[id(n)] = _sum(grads[id(n)])
        match n.kind:
            case "einsum":
                parts = _einsum(n, u, between)
            case "select":
                parts = []
                for x, (begin, end, offset) in zip(n.inputs, n.p["boxes"], strict=True):
                    here = G.subset(u, offset, [o + e - b for o, b, e in zip(offset, begin, end, strict=True)])
                    parts.append(G.pad(here, x.shape, begin))
            case "to_complex":
                parts = [G.to_real(u)]
            case "to_real":
                parts = [G.to_complex(u)]
            case "squeeze":
                parts = [G.squeeze(u, n.inputs[0].shape)]
            case "formation":
                parts = [u]
            case _:
                parts = []
        for x, g in zip(n.inputs, parts, strict=False):
            if g is not None and id(x) in between:
                grads.setdefault(id(x), []).append(g)
    return [Tensor.of(done[id(w)] if id(w) in done else G.constant(0.0, w.shape, w.dtype)) for w in nodes]
