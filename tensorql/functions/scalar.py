"""The scalar language of tensor expressions: trees, text form, simplification, derivatives, Spark columns.

A tree maps argument values ("holes") to one value. Text form:
    +[a,b]  *[a,b]  exp[a]  log[a]  power{p}[a]  ite_<[l,r,t,f]  to_f32[a]
    conj[a]  real[a]  imag[a]  complex[a,b]  hole|f32@0  constant{f32|1.0}  variable{name|f32}
There is no implicit promotion: + and * take equal types; conversions are explicit and real.

Edge cases follow IEEE arithmetic rather than SQL's: division is a power of -1 (infinite at
zero), log(0) is -inf and log of a negative number NaN, comparisons with NaN are false.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL = ("f16", "f32", "f64")
COMPLEX = "c64"
SPARK = {"f16": "float", "f32": "float", "f64": "double", "c64": "struct<re:float,im:float>"}
COMPARES = ("<", ">", "==", "<=", ">=")
AGGREGATES = ("add", "mul", "min", "max")


@dataclass(frozen=True)
class Scalar:
    op: str
    args: tuple[Scalar, ...] = ()
    dtype: str = "f64"
    payload: Any = None

    def __str__(self) -> str:
        inner = ",".join(map(str, self.args))
        match self.op:
            case "constant":
                v = self.payload
                return f"constant{{{self.dtype}|{v.real},{v.imag}}}" if self.dtype == COMPLEX else f"constant{{{self.dtype}|{v}}}"
            case "hole":
                return f"hole|{self.dtype}@{self.payload}"
            case "variable":
                return f"variable{{{self.payload}|{self.dtype}}}"
            case "add" | "mul":
                return f"{'+' if self.op == 'add' else '*'}[{inner}]"
            case "power":
                return f"power{{{self.payload}}}[{inner}]"
            case "ite":
                return f"ite_{self.payload}[{inner}]"
            case "convert":
                return f"to_{self.dtype}[{inner}]"
        return f"{self.op}[{inner}]"

    def holes(self) -> set[int]:
        return {self.payload} if self.op == "hole" else set().union(*(a.holes() for a in self.args))

    def variables(self) -> set[str]:
        return {self.payload} if self.op == "variable" else set().union(*(a.variables() for a in self.args))

    def hole_dtypes(self) -> dict[int, str]:
        return {self.payload: self.dtype} if self.op == "hole" else {k: v for a in self.args for k, v in a.hole_dtypes().items()}

    def replace(self, args: dict[int, Scalar]) -> Scalar:
        """Holes shared: hole i becomes args[i]."""
        if self.op == "hole":
            return args.get(self.payload, self)
        return simplify(Scalar(self.op, tuple(a.replace(args) for a in self.args), self.dtype, self.payload))

    def is_constant(self) -> bool:
        return not self.holes()

    def is_unary(self) -> bool:
        return len(self.holes()) == 1

    def is_binary(self) -> bool:
        return len(self.holes()) == 2

    def is_constant_of(self, v: complex | float) -> bool:
        return self.op == "constant" and self.payload == v

    def is_identity(self) -> bool:
        return self == hole(0, self.dtype)

    def aggregate_of(self) -> str | None:
        """The aggregate that this function of two arguments is the step of."""
        ordered = self.dtype != COMPLEX
        return next((a for a in AGGREGATES if (ordered or a in ("add", "mul")) and self == from_aggregate(a, self.dtype)), None)

    def get_scale(self) -> complex | float | None:
        """c, if this is c times its only argument."""
        if self.op != "mul":
            return None
        c, x = sorted(self.args, key=lambda a: a.op != "constant")
        return c.payload if c.op == "constant" and x == hole(0, x.dtype) else None

    def bind(self, values: dict[str, float]) -> Scalar:
        if self.op == "variable" and self.payload in values:
            return constant(values[self.payload], self.dtype)
        return simplify(Scalar(self.op, tuple(a.bind(values) for a in self.args), self.dtype, self.payload))


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


# Primitive nodes.


def constant(v: complex | float, dtype: str = "f64") -> Scalar:
    return Scalar("constant", (), dtype, complex(v) if dtype == COMPLEX else float(v))


def hole(i: int = 0, dtype: str = "f64") -> Scalar:
    return Scalar("hole", (), dtype, i)


def variable(name: str, dtype: str = "f64") -> Scalar:
    return Scalar("variable", (), dtype, name)


def _same(op: str, a: Scalar, b: Scalar) -> Scalar:
    _check(a.dtype == b.dtype, f"{op} of {a.dtype} and {b.dtype}: convert first")
    return simplify(Scalar(op, (a, b), a.dtype))


def add(a: Scalar, b: Scalar) -> Scalar:
    return _same("add", a, b)


def mul(a: Scalar, b: Scalar) -> Scalar:
    return _same("mul", a, b)


def _real(op: str, a: Scalar, payload: Any = None) -> Scalar:
    _check(a.dtype in REAL, f"{op} takes real numbers")
    return simplify(Scalar(op, (a,), a.dtype, payload))


def exp(a: Scalar) -> Scalar:
    return _real("exp", a)


def log(a: Scalar) -> Scalar:
    return _real("log", a)


def power(a: Scalar, p: float) -> Scalar:
    return _real("power", a, float(p))


def ite(compare: str, left: Scalar, right: Scalar, then: Scalar, other: Scalar) -> Scalar:
    _check(compare in COMPARES, f"unknown comparison {compare}")
    _check(left.dtype == right.dtype and left.dtype in REAL and then.dtype == other.dtype, "ite compares real numbers of one type and has branches of one type")
    return simplify(Scalar("ite", (left, right, then, other), then.dtype, compare))


def convert(a: Scalar, dtype: str) -> Scalar:
    _check(a.dtype in REAL and dtype in REAL, "conversions are between real types")
    return a if a.dtype == dtype else simplify(Scalar("convert", (a,), dtype))


def conj(a: Scalar) -> Scalar:
    _check(a.dtype == COMPLEX, "conj takes complex numbers")
    return simplify(Scalar("conj", (a,), COMPLEX))


def real(a: Scalar) -> Scalar:
    _check(a.dtype == COMPLEX, "real takes complex numbers")
    return Scalar("real", (a,), "f32")


def imag(a: Scalar) -> Scalar:
    _check(a.dtype == COMPLEX, "imag takes complex numbers")
    return Scalar("imag", (a,), "f32")


def cplex(re_: Scalar, im: Scalar) -> Scalar:
    _check(re_.dtype == im.dtype == "f32", "complex takes two f32")
    return Scalar("complex", (re_, im), COMPLEX)


# Named functions. x and y stand for arguments 0 and 1.


def div(d: str = "f64") -> Scalar:
    return mul(hole(0, d), power(hole(1, d), -1))


def neg(d: str = "f64") -> Scalar:
    return mul(constant(-1, d), hole(0, d))


def minimum(d: str = "f64") -> Scalar:
    return ite("<", hole(0, d), hole(1, d), hole(0, d), hole(1, d))


def maximum(d: str = "f64") -> Scalar:
    return ite(">", hole(0, d), hole(1, d), hole(0, d), hole(1, d))


def mask(compare: str, d: str = "f64") -> Scalar:
    return ite(compare, hole(0, d), hole(1, d), constant(1, d), constant(0, d))


def is_min(d: str = "f64") -> Scalar:
    return mask("<=", d)


def is_max(d: str = "f64") -> Scalar:
    return mask(">=", d)


def is_equal(d: str = "f64") -> Scalar:
    return mask("==", d)


def scale_which(v: float | str, which: int, d: str = "f64") -> Scalar:
    return mul(variable(v, d) if isinstance(v, str) else constant(v, d), hole(which, d))


def scale(v: float | str, d: str = "f64") -> Scalar:
    return scale_which(v, 0, d)


def sub(d: str = "f64") -> Scalar:
    return add(hole(0, d), mul(constant(-1, d), hole(1, d)))


def increment(v: float, d: str = "f64") -> Scalar:
    return add(hole(0, d), constant(v, d))


def sigmoid(d: str = "f64") -> Scalar:
    return power(add(constant(1, d), exp(neg(d))), -1)


def silu(d: str = "f64") -> Scalar:
    return mul(hole(0, d), sigmoid(d))


def sqrt(d: str = "f64") -> Scalar:
    return power(hole(0, d), 0.5)


def inverse(d: str = "f64") -> Scalar:
    return power(hole(0, d), -1)


rcp = inverse


def inverse_sqrt(d: str = "f64") -> Scalar:
    return power(hole(0, d), -0.5)


def square(d: str = "f64") -> Scalar:
    return power(hole(0, d), 2)


def relu(d: str = "f64") -> Scalar:
    return ite("<=", hole(0, d), constant(0, d), constant(0, d), hole(0, d))


def relu_deriv(d: str = "f64") -> Scalar:
    """0 at 0."""
    return ite("<=", hole(0, d), constant(0, d), constant(0, d), constant(1, d))


def from_aggregate(agg: str, d: str = "f64") -> Scalar:
    x, y = hole(0, d), hole(1, d)
    return {"add": lambda: add(x, y), "mul": lambda: mul(x, y), "min": lambda: minimum(d), "max": lambda: maximum(d)}[agg]()


def combine(outer: Scalar, inner: list[Scalar]) -> Scalar:
    """outer of inner, each inner function with arguments of its own, numbered on."""
    at, fresh = 0, {}
    for i, s in enumerate(inner):
        fresh[i] = s.replace({k: hole(k + at, d) for k, d in s.hole_dtypes().items()})
        at += max(s.holes(), default=-1) + 1
    return outer.replace(fresh)


# Simplification. Nothing that would hide a NaN or an infinity: 0 * x stays.


def _value(op: str, args: list, payload: Any) -> Any:
    match op:
        case "add":
            return args[0] + args[1]
        case "mul":
            return args[0] * args[1]
        case "exp":
            return math.exp(args[0]) if args[0] < 700 else math.inf
        case "log":
            return math.log(args[0]) if args[0] > 0 else -math.inf if args[0] == 0 else math.nan
        case "power":
            x, p = args[0], payload
            if x == 0 and p < 0:
                return math.inf
            return math.nan if x < 0 and p != int(p) else x**p
        case "ite":
            a, b, t, f = args
            return t if {"<": a < b, ">": a > b, "==": a == b, "<=": a <= b, ">=": a >= b}[payload] else f
    return NotImplemented


def simplify(s: Scalar) -> Scalar:
    a = s.args
    if a and all(x.op == "constant" for x in a) and s.op in ("add", "mul", "exp", "log", "power", "ite"):
        return constant(_value(s.op, [x.payload for x in a], s.payload), s.dtype)
    one = lambda x, v: x.op == "constant" and x.payload == v
    if s.op == "add":
        if one(a[0], 0) or one(a[1], 0):
            return a[1] if one(a[0], 0) else a[0]
    elif s.op == "mul":
        if one(a[0], 1) or one(a[1], 1):
            return a[1] if one(a[0], 1) else a[0]
        c, x = (a[0], a[1]) if a[0].op == "constant" else (a[1], a[0])
        if c.op == "constant" and x.op == "mul" and any(y.op == "constant" for y in x.args):
            k, rest = (x.args[0], x.args[1]) if x.args[0].op == "constant" else (x.args[1], x.args[0])
            return simplify(Scalar("mul", (constant(c.payload * k.payload, s.dtype), rest), s.dtype))
    elif s.op == "power":
        if s.payload == 1:
            return a[0]
        if s.payload == 0:
            return constant(1, s.dtype)
    elif s.op == "ite" and a[2] == a[3]:
        return a[2]
    elif s.op == "conj" and a[0].op == "conj":
        return a[0].args[0]
    elif s.op == "conj" and a[0].op == "constant":
        return constant(a[0].payload.conjugate(), COMPLEX)
    elif s.op == "convert" and a[0].op == "constant":
        return constant(a[0].payload, s.dtype)
    return s


# Text.

_TOKEN = re.compile(r"hole\|(\w+)@(\d+)|constant\{(\w+)\|([^}]*)\}|variable\{([^|}]*)\|(\w+)\}|power\{([^}]*)\}\[|ite_(<=|>=|==|<|>)\[|to_(\w+)\[|([+*])\[|(exp|log|conj|real|imag|complex)\[")


def parse(text: str) -> Scalar:
    text = text.replace(" ", "")
    s, at = _parse(text, 0)
    _check(at == len(text), f"unread text at {at}: {text[at:]}")
    return s


def _parse(text: str, at: int) -> tuple[Scalar, int]:
    m = _TOKEN.match(text, at)
    _check(m is not None, f"no expression at {at}: {text[at:at + 20]}")
    at = m.end()
    if m[1]:
        return hole(int(m[2]), m[1]), at
    if m[3]:
        return constant(complex(*map(float, m[4].split(","))) if m[3] == COMPLEX else float(m[4]), m[3]), at
    if m[5] is not None:
        return variable(m[5], m[6]), at
    args = []
    while True:
        arg, at = _parse(text, at)
        args.append(arg)
        _check(at < len(text) and text[at] in ",]", f"expected , or ] at {at}")
        at += 1
        if text[at - 1] == "]":
            break
    if m[7]:
        return power(*args, float(m[7])), at
    if m[8]:
        return ite(m[8], *args), at
    if m[9]:
        return convert(*args, m[9]), at
    if m[10]:
        return (add if m[10] == "+" else mul)(*args), at
    return {"exp": exp, "log": log, "conj": conj, "real": real, "imag": imag, "complex": cplex}[m[11]](*args), at


# Derivatives.


def derivative(s: Scalar, i: int) -> Scalar:
    """By the real argument i."""
    _check(s.dtype in REAL, "derivatives are of real functions")
    d, a = s.dtype, s.args
    zero = constant(0, d)
    if s.op == "hole":
        return constant(1 if s.payload == i else 0, d)
    if i not in s.holes():
        return zero
    match s.op:
        case "add":
            return add(derivative(a[0], i), derivative(a[1], i))
        case "mul":
            parts = [mul(derivative(x, i), y) for x, y in ((a[0], a[1]), (a[1], a[0])) if i in x.holes()]
            return reduce(add, parts)
        case "exp":
            return mul(s, derivative(a[0], i))
        case "log":
            return mul(power(a[0], -1), derivative(a[0], i))
        case "power":
            return mul(mul(constant(s.payload, d), power(a[0], s.payload - 1)), derivative(a[0], i))
        case "ite":
            return ite(s.payload, a[0], a[1], derivative(a[2], i), derivative(a[3], i))
        case "convert":
            return convert(derivative(a[0], i), d)
    raise ValueError(f"no derivative of {s.op}")


def wirtinger(s: Scalar, i: int) -> tuple[Scalar, Scalar]:
    """(d/dz, d/d conj z) of a complex function of sums, products and conjugates."""
    one, zero = constant(1, COMPLEX), constant(0, COMPLEX)
    if s.op == "hole" and s.dtype == COMPLEX:
        return (one, zero) if s.payload == i else (zero, zero)
    if i not in s.holes():
        return zero, zero
    d = lambda x: wirtinger(x, i)
    nil = lambda x, y: zero if x == zero or y == zero else mul(x, y)
    match s.op:
        case "add":
            return tuple(add(x, y) for x, y in zip(d(s.args[0]), d(s.args[1]), strict=True))
        case "mul":
            (f, g), (df, dg) = s.args, map(d, s.args)
            return tuple(add(nil(x, g), nil(f, y)) for x, y in zip(df, dg, strict=True))
        case "conj":
            x, y = d(s.args[0])
            return conj(y) if y != zero else zero, conj(x) if x != zero else zero
    raise ValueError(f"no complex derivative of {s.op}")


# Spark columns.


def _struct(re_: Column, im: Column) -> Column:
    return F.struct(re_.cast("float").alias("re"), im.cast("float").alias("im"))


def to_column(s: Scalar, holes: list[Column], values: dict[str, float] | None = None) -> Column:
    """values: of variables."""
    values = values or {}
    go = lambda x: to_column(x, holes, values)
    kind = SPARK[s.dtype]
    match s.op:
        case "constant":
            if s.dtype == COMPLEX:
                return _struct(F.lit(s.payload.real), F.lit(s.payload.imag))
            return F.lit(s.payload).cast(kind)
        case "hole":
            return holes[s.payload]
        case "variable":
            _check(s.payload in values, f"no value for variable {s.payload}")
            return F.lit(values[s.payload]).cast(kind)
        case "conj":
            x = go(s.args[0])
            return _struct(x["re"], -x["im"])
        case "real" | "imag":
            return go(s.args[0])["re" if s.op == "real" else "im"]
        case "complex":
            return _struct(go(s.args[0]), go(s.args[1]))
    a = [go(x) for x in s.args]
    if s.dtype == COMPLEX and s.op in ("add", "mul"):
        x, y = a
        if s.op == "add":
            return _struct(x["re"] + y["re"], x["im"] + y["im"])
        return _struct(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])
    match s.op:
        case "add":
            return a[0] + a[1]
        case "mul":
            return a[0] * a[1]
        case "exp":
            out = F.exp(a[0])
        case "log":
            out = F.when(a[0] > 0, F.log(a[0])).when(a[0] == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
        case "power":
            # Small whole powers are products: faster, and the same digits everywhere.
            out = a[0] * a[0] if s.payload == 2 else F.sqrt(a[0]) if s.payload == 0.5 else F.pow(a[0], F.lit(s.payload))
        case "ite":
            x, y = a[0], a[1]
            holds = {"<": x < y, ">": x > y, "==": x == y, "<=": x <= y, ">=": x >= y}[s.payload]
            return F.when(holds & ~F.isnan(x) & ~F.isnan(y), a[2]).otherwise(a[3])
        case "convert":
            return a[0].cast(kind)
        case _:
            raise ValueError(f"no column for {s.op}")
    return out if kind == "double" else out.cast(kind)
