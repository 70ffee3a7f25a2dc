"""Tensor programs: a lazy graph of nodes, and the handles that build it.

A tensor is a relation from integer positions to values with one row for each position. The
graph is plain Python; operators/lowering.py turns it into DataFrames. Shapes and types are
checked as nodes are made.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod
from typing import Any

from tensorql.functions import scalar as S
from tensorql.plans.spec import Spec


@dataclass(frozen=True, eq=False)
class Node:
    """kinds: input(df), constant(value), lowertri(lower, upper, start), einsum(spec, join, agg), select(boxes), pad(offset),
    to_complex, to_real, squeeze, formation."""

    kind: str
    shape: tuple[int, ...]
    dtype: str
    inputs: tuple[Node, ...] = ()
    p: dict[str, Any] = field(default_factory=dict)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def make(kind: str, shape, dtype: str, inputs=(), **p) -> Node:
    shape = tuple(int(n) for n in shape)
    _need(len(shape) > 0 and min(shape) > 0, f"shape {shape}: at least one dimension, none of size 0")
    return Node(kind, shape, dtype, tuple(inputs), p)


def constant(value: float | complex, shape, dtype: str = "f64") -> Node:
    return make("constant", shape, dtype, value=value)


def lowertri(lower: float, upper: float, nrow: int, ncol: int, start: int = 0, dtype: str = "f64") -> Node:
    """lower where row - start >= column, else upper."""
    if -start >= ncol - 1:
        return constant(lower, (nrow, ncol), dtype)
    if nrow - 1 - start < 0 or lower == upper:
        return constant(upper, (nrow, ncol), dtype)
    return make("lowertri", (nrow, ncol), dtype, lower=lower, upper=upper, start=start)


def einsum(spec: str | Spec, inputs, join: S.Scalar | None = None, agg: str | None = None, out_shape=None) -> Node:
    """out[o] = agg over the other labels of join(x0[..], x1[..], ..)."""
    spec = Spec.parse(spec) if isinstance(spec, str) else spec
    inputs = tuple(inputs)
    _need(len(inputs) == len(spec.terms), f"{spec} takes {len(spec.terms)} tensors")
    join = S.hole(0, inputs[0].dtype) if join is None else join
    _need(join.holes() == set(range(len(inputs))), "every input is used by the join function, and no other")
    for i, d in join.hole_dtypes().items():
        _need(inputs[i].dtype == d, f"argument {i} is {inputs[i].dtype}, the function takes {d}")
    sizes = spec.sizes([x.shape for x in inputs], out_shape)
    _need(bool(spec.aggregated) <= (agg is not None), f"{spec} aggregates: say how")
    _need(agg in (None, *S.AGGREGATES), f"unknown aggregate {agg}")
    _need(not (join.dtype == S.COMPLEX and agg in ("min", "max")), "complex numbers have no order")
    if len(inputs) == 1 and spec.classify() == "identity" and join.op == "hole":
        return inputs[0]
    agg = agg if spec.aggregated else None
    return make("einsum", [sizes[c] for c in spec.out], join.dtype, inputs, spec=spec, join=join, agg=agg, sizes=sizes)


def resized(node: Node, inputs, out_shape=None) -> Node:
    """The same einsum over inputs of other sizes."""
    _need(node.kind == "einsum", "only an einsum has a join shape")
    return einsum(node.p["spec"], inputs, node.p["join"], node.p["agg"], out_shape)


def select(out_shape, pieces) -> Node:
    """pieces: (node, begin, end, offset); the box [begin, end) of the node goes to offset. Boxes tile the output exactly."""
    pieces = list(pieces)
    covered = sum(prod(e - b for b, e in zip(begin, end, strict=True)) for _, begin, end, _ in pieces)
    boxes = [tuple(zip(o, (x + e - b for x, b, e in zip(o, begin, end, strict=True)), strict=True)) for _, begin, end, o in pieces]
    for i, a in enumerate(boxes):
        _need(all(0 <= lo < hi <= n for (lo, hi), n in zip(a, out_shape, strict=True)), f"{a} lies outside {out_shape}")
        for b in boxes[:i]:
            _need(any(h1 <= l2 or h2 <= l1 for (l1, h1), (l2, h2) in zip(a, b, strict=True)), "boxes overlap")
    for node, begin, end, _ in pieces:
        _need(all(0 <= b < e <= n for b, e, n in zip(begin, end, node.shape, strict=True)), f"[{begin}, {end}) lies outside {node.shape}")
    _need(covered == prod(out_shape), "boxes don't cover the output")
    _need(len({p[0].dtype for p in pieces}) == 1, "pieces are of one type")
    first = pieces[0]
    if len(pieces) == 1 and first[0].kind == "constant":
        return constant(first[0].p["value"], out_shape, first[0].dtype)
    if len(pieces) == 1 and first[0].kind == "lowertri":
        p, (row, column) = first[0].p, first[1]
        return lowertri(p["lower"], p["upper"], *out_shape, p["start"] - row + column, first[0].dtype)
    if len(pieces) == 1 and tuple(first[0].shape) == tuple(out_shape):
        return first[0]  # the full range
    return make("select", out_shape, first[0].dtype, [p[0] for p in pieces], boxes=[tuple(map(tuple, p[1:])) for p in pieces])


def subset(node: Node, begin, end) -> Node:
    return select([e - b for b, e in zip(begin, end, strict=True)], [(node, tuple(begin), tuple(end), (0,) * len(begin))])


def concat(dim: int, nodes) -> Node:
    nodes = list(nodes)
    _need(len(nodes) >= 2, "concat takes two tensors or more")
    shape = list(nodes[0].shape)
    shape[dim] = sum(n.shape[dim] for n in nodes)
    at, pieces = 0, []
    for n in nodes:
        _need(all(a == b for k, (a, b) in enumerate(zip(n.shape, shape, strict=True)) if k != dim), "other sizes differ")
        pieces.append((n, (0,) * len(shape), n.shape, tuple(at if k == dim else 0 for k in range(len(shape)))))
        at += n.shape[dim]
    return select(shape, pieces)


def pad(node: Node, shape, offset) -> Node:
    """node at offset in zeros."""
    return node if tuple(shape) == node.shape else make("pad", shape, node.dtype, [node], offset=tuple(offset))


def to_complex(node: Node) -> Node:
    _need(node.dtype == "f32" and node.shape[-1] % 2 == 0, "pairs of f32 in an even last dimension make complex numbers")
    return make("to_complex", (*node.shape[:-1], node.shape[-1] // 2), S.COMPLEX, [node])


def to_real(node: Node) -> Node:
    _need(node.dtype == S.COMPLEX, "to_real takes complex numbers")
    return make("to_real", (*node.shape[:-1], node.shape[-1] * 2), "f32", [node])


def squeeze(node: Node, shape) -> Node:
    """Adds or removes dimensions of size 1."""
    _need([n for n in node.shape if n != 1] == [n for n in shape if n != 1], f"{node.shape} to {shape} changes more than sizes of 1")
    _need(node.dtype != S.COMPLEX, "not on complex numbers")
    return node if tuple(shape) == node.shape else make("squeeze", shape, node.dtype, [node])


def formation(node: Node) -> Node:
    """The same tensor, formed: written once, however many use it."""
    return node if node.kind in ("input", "constant", "lowertri", "formation") else make("formation", node.shape, node.dtype, [node])


def rng(begin: int, end: int) -> slice:
    return slice(begin, end)


@dataclass(frozen=True, eq=False)
class Tensor:
    """A node seen through groups of its dimensions: groups[i] are the node's dimensions that make up dimension i.

    Transposing and viewing rename; nothing is computed until an operation needs it.
    """

    node: Node
    groups: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(node: Node) -> Tensor:
        return Tensor(node, tuple((k,) for k in range(len(node.shape))))

    @property
    def full_shape(self) -> tuple[tuple[int, ...], ...]:
        return tuple(tuple(self.node.shape[k] for k in g) for g in self.groups)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(prod(s) for s in self.full_shape)

    @property
    def dtype(self) -> str:
        return self.node.dtype

    def transpose(self, i: int, j: int) -> Tensor:
        g = list(self.groups)
        g[i], g[j] = g[j], g[i]
        return Tensor(self.node, tuple(g))

    def view(self, shape) -> Tensor:
        """Other groups of the same flat dimensions: (50,) of 10 and 5 as 50, or as 10, 5. No general reshape."""
        flat = [k for g in self.groups for k in g]
        groups, at = [], 0
        for n in shape:
            got, size = [], 1
            while at < len(flat) and (size < n or not got):
                size *= self.node.shape[flat[at]]
                got.append(flat[at])
                at += 1
            _need(size == n, f"{self.full_shape} can't be seen as {tuple(shape)}")
            groups.append(tuple(got))
        while at < len(flat) and groups and self.node.shape[flat[at]] == 1:
            groups[-1] += (flat[at],)
            at += 1
        _need(at == len(flat), f"{self.full_shape} can't be seen as {tuple(shape)}")
        return Tensor(self.node, tuple(groups))

    def view_full(self) -> Tensor:
        return Tensor(self.node, tuple((k,) for g in self.groups for k in g))

    def permuted(self) -> Tensor:
        """The same tensor with the node's dimensions in the order of the view."""
        flat = [k for g in self.groups for k in g]
        names = "abcdefghijklmnopqrstuvwxyz"[: len(flat)]
        node = einsum(f"{names}->{''.join(names[k] for k in flat)}", [self.node])
        at, groups = 0, []
        for g in self.groups:
            groups.append(tuple(range(at, at + len(g))))
            at += len(g)
        return Tensor(node, tuple(groups))

    def subset(self, *index) -> Tensor:
        """Each of int (that position, dimension gone), slice or ... for all; negatives count from the end."""
        t = self.permuted()
        _need(all(len(g) == 1 for g in t.groups) and len(index) == len(t.groups), "one index for each ungrouped dimension")
        begin, end, keep = [], [], []
        for x, n in zip(index, t.shape, strict=True):
            if isinstance(x, int):
                x = x + n if x < 0 else x
                begin.append(x)
                end.append(x + 1)
            else:
                b, e, step = (x if isinstance(x, slice) else slice(None)).indices(n)
                _need(step == 1, "steps aren't taken")
                begin.append(b)
                end.append(e)
                keep.append(e - b)
        node = subset(t.node, begin, end)
        return Tensor.of(squeeze(node, keep or [1]) if len(keep) < len(index) else node)

    def squeeze(self, dim: int) -> Tensor:
        t = self.permuted()
        return Tensor.of(squeeze(t.node, [n for k, n in enumerate(t.node.shape) if k != dim]))

    def unsqueeze(self, dim: int) -> Tensor:
        t = self.permuted()
        return Tensor.of(squeeze(t.node, [*t.node.shape[:dim], 1, *t.node.shape[dim:]]))

    def formed(self) -> Tensor:
        return Tensor(formation(self.node), self.groups)

    def to_real(self) -> Tensor:
        return Tensor.of(to_real(self.permuted().node))

    def to_complex(self) -> Tensor:
        return Tensor.of(to_complex(self.permuted().node))

    def to_dtype(self, dtype: str) -> Tensor:
        return self if dtype == self.dtype else ew(S.convert(S.hole(0, self.dtype), dtype), self)

    def to_f16(self) -> Tensor:
        return self.to_dtype("f16")

    def to_f32(self) -> Tensor:
        return self.to_dtype("f32")

    def to_f64(self) -> Tensor:
        return self.to_dtype("f64")

    def __add__(self, other: Tensor) -> Tensor:
        return add(self, other)

    def __mul__(self, other: Tensor) -> Tensor:
        return mul(self, other)

    def __matmul__(self, other: Tensor) -> Tensor:
        return matmul(self, other)


def apply(spec: str, tensors: list[Tensor], join: S.Scalar | None = None, agg: str | None = None, out_sizes: dict[str, tuple[int, ...]] | None = None) -> Tensor:
    """An einsum over views: a label stands for all flat dimensions of its group. out_sizes: of broadcast labels."""
    s = Spec.parse(spec)
    full: dict[str, tuple[int, ...]] = dict(out_sizes or {})
    for term, t in zip(s.terms, tensors, strict=True):
        _need(len(term) == len(t.groups), f"{term} does not fit {t.shape}")
        for c, sizes in zip(term, t.full_shape, strict=True):
            _need(full.setdefault(c, sizes) == sizes, f"label {c} is {full[c]} and {sizes}")
    _need(all(c in full for c in s.out), "sizes of broadcast labels aren't given")
    code = iter(map(chr, range(0x100, 0x2000)))
    flat = {c: [next(code) for _ in full[c]] for c in s.labels}
    terms = []
    for term, t in zip(s.terms, tensors, strict=True):
        place = {k: x for c, g in zip(term, t.groups, strict=True) for x, k in zip(flat[c], g, strict=True)}
        terms.append("".join(place[k] for k in range(len(t.node.shape))))
    out = "".join(x for c in s.out for x in flat[c])
    shape = [n for c in s.out for n in full[c]]
    node = einsum(Spec(tuple(terms), out), [t.node for t in tensors], join, agg, tuple(shape))
    if node is tensors[0].node:
        return tensors[0]
    at, groups = 0, []
    for c in s.out:
        groups.append(tuple(range(at, at + len(full[c]))))
        at += len(full[c])
    return Tensor(node, tuple(groups))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def input_(df, shape, dtype: str = "f64") -> Tensor:
    """df: columns d0, d1, .. (int) and val, one row for each position."""
    return Tensor.of(make("input", shape, dtype, df=df))


def fill(value, shape, dtype: str = "f64") -> Tensor:
    return Tensor.of(constant(value, shape, dtype))


def triangle(lower: float, upper: float, nrow: int, ncol: int, start: int = 0, dtype: str = "f64") -> Tensor:
    return Tensor.of(lowertri(lower, upper, nrow, ncol, start, dtype))


def contraction(spec: str, a: Tensor, b: Tensor) -> Tensor:
    return apply(spec, [a, b], S.mul(S.hole(0, a.dtype), S.hole(1, b.dtype)), "add")


def reduction(spec: str, agg: str, x: Tensor) -> Tensor:
    return apply(spec, [x], None, agg)


def ew(f: S.Scalar, *xs: Tensor, spec: str | None = None) -> Tensor:
    """f at each position. Without a spec, all tensors have one shape. Nothing is aggregated."""
    names = LETTERS[: len(xs[0].groups)]
    spec = spec or f"{','.join([names] * len(xs))}->{names}"
    _need(not Spec.parse(spec).aggregated, "ew doesn't aggregate")
    return apply(spec, list(xs), f)


def add(a: Tensor, b: Tensor) -> Tensor:
    return ew(S.add(S.hole(0, a.dtype), S.hole(1, b.dtype)), a, b)


def mul(a: Tensor, b: Tensor) -> Tensor:
    return ew(S.mul(S.hole(0, a.dtype), S.hole(1, b.dtype)), a, b)


def scale(v: float | str, x: Tensor) -> Tensor:
    return ew(S.scale(v, x.dtype), x)


def exp(x: Tensor) -> Tensor:
    return ew(S.exp(S.hole(0, x.dtype)), x)


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """2d by 2d, or batched on either side or both."""
    m, n = len(a.groups), len(b.groups)
    batch = LETTERS[: max(m, n) - 2]
    return contraction(f"{batch if m > 2 else ''}xy,{batch if n > 2 else ''}yz->{batch}xz", a, b)


def cat(dim: int, tensors: list[Tensor]) -> Tensor:
    ts = [t.permuted() for t in tensors]
    _need(all(len(t.groups[dim]) == 1 for t in ts), "concat is along an ungrouped dimension")
    flat = ts[0].groups[dim][0]
    return Tensor(concat(flat, [t.node for t in ts]), ts[0].groups)


def broadcast(size: int, x: Tensor) -> Tensor:
    """j->ij."""
    names = LETTERS[: len(x.groups)]
    return apply(f"{names}->z{names}", [x], out_sizes={"z": (size,)})


def sum_to_unit(x: Tensor) -> Tensor:
    """The sum of all, of shape [1]."""
    names = LETTERS[: len(x.groups)]
    total = apply(f"z{names}->z", [Tensor.of(squeeze(x.permuted().node, (1, *x.permuted().node.shape))).view((1, *x.shape))], None, "add")
    return total


def _rows(x: Tensor) -> tuple[str, str]:
    names = LETTERS[: len(x.groups)]
    return names, names[:-1]


def softmax_v1(x: Tensor) -> Tensor:
    """Over the last dimension: max, exponentials of what is less, their sum, quotient; four steps."""
    n, h = _rows(x)
    d = x.dtype
    e = exp(ew(S.sub(d), x, reduction(f"{n}->{h}", "max", x), spec=f"{n},{h}->{n}"))
    return ew(S.div(d), e, reduction(f"{n}->{h}", "add", e), spec=f"{n},{h}->{n}")


def softmax_v2(x: Tensor) -> Tensor:
    """As v1, with the difference and the exponential in one function, and the sum's inverse taken once a row."""
    n, h = _rows(x)
    d = x.dtype
    e = ew(S.exp(S.sub(d)), x, reduction(f"{n}->{h}", "max", x), spec=f"{n},{h}->{n}")
    inverse = ew(S.inverse(d), reduction(f"{n}->{h}", "add", e))
    return ew(S.mul(S.hole(0, d), S.hole(1, d)), e, inverse, spec=f"{n},{h}->{n}")


def softmax_v3(x: Tensor, alpha: float | str = 1.0) -> Tensor:
    """softmax(alpha x), alpha applied after the shift; the exponentials' sum and the result are joins of three and two."""
    n, h = _rows(x)
    d = x.dtype
    top = reduction(f"{n}->{h}", "max", x)
    shifted = S.exp(S.scale(alpha, d).replace({0: S.sub(d)}))
    total = apply(f"{n},{h}->{h}", [x, top], shifted, "add")
    return ew(S.mul(shifted, S.power(S.hole(2, d), -1)), x, top, total, spec=f"{n},{h},{h}->{n}")


softmax = softmax_v1
