"""From tensor graphs to DataFrames, one row for each position: d0, d1, .., val.

Joins are equi-joins on shared labels and aggregations are groupBys, so partial aggregation,
join strategy and skew handling are Catalyst's and AQE's. Renaming labels costs nothing.

Plans grow with the graph, not with the number of paths in it:

* A node with a value for each row of another (elementwise functions, and functions of a row's
  own sum, maximum and the like) is a column beside the other's, not a join: chains of them,
  softmaxes and norms among them, are projections and windows over one relation. A window holds
  a row of ROW values at most; longer rows are aggregated and joined.
* A node that several joins take, and whose own plan has more than HEAVY joins and aggregations,
  is formed: written once to the shared folder. formation nodes always are.
* Sums of products of which each value is used often are contracted block by block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from itertools import count
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tensorql.functions import scalar as S
from tensorql.operators import blocked
from tensorql.plans.graph import Node, Tensor
from tensorql.sources.store import materialize


def keys(rank: int) -> list[str]:
    return [f"d{k}" for k in range(rank)]


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """Every position of a shape."""
    df, rest = spark.range(prod(shape)), prod(shape)
    cols = []
    for k, n in enumerate(shape):
        rest //= n
        cols.append(F.expr(f"cast(id div {rest} % {n} as int)").alias(f"d{k}"))
    return df.select(*cols)


def literal(v, dtype: str) -> Column:
    return S.to_column(S.constant(v, dtype), [])


def aggregate(agg: str, dtype: str, x: Column, over: WindowSpec | None = None) -> Column:
    of = lambda c: c.over(over) if over else c
    if dtype == S.COMPLEX:
        re, im = x["re"].cast("double"), x["im"].cast("double")
        if agg == "add":
            re, im = of(F.sum(re)), of(F.sum(im))
        else:  # in polar form, so that partial products can be merged
            size, angle = of(F.product(F.sqrt(re * re + im * im))), of(F.sum(F.atan2(im, re)))
            re, im = size * F.cos(angle), size * F.sin(angle)
        return F.struct(re.cast("float").alias("re"), im.cast("float").alias("im"))
    found = {"add": F.sum, "mul": F.product, "min": F.min, "max": F.max}[agg](x.cast("double") if agg in ("add", "mul") else x)
    return of(found).cast(S.SPARK[dtype])


#: Values of a row that a window may hold; joins and aggregations of a plan that is not computed twice.
ROW, HEAVY = 1 << 16, 8
#: Contractions of so many products, and so many for each value that goes in, are done by blocks: else each product is a row.
PRODUCTS, INTENSITY = 1 << 24, 2


@dataclass(frozen=True)
class Rows:
    """A node's values: the column `val` of base, once the steps have added their columns to it, in order."""

    base: DataFrame
    val: str
    steps: tuple[tuple[str, Column], ...] = ()
    weight: int = 0

    def whole(self) -> DataFrame:
        df = self.base
        for name, column in self.steps:
            df = df.withColumn(name, column)
        return df

    def df(self, rank: int) -> DataFrame:
        return self.whole().select(*keys(rank), F.col(self.val).alias("val"))


class Lowering:
    """Values of variables are bound here. Each node is lowered once; nodes named in `keep` are cached."""

    def __init__(self, spark: SparkSession, variables: dict[str, float] | None = None, keep: list[Node] = (), products: int = PRODUCTS):
        self.spark, self.variables, self.keep, self.products = spark, variables or {}, {id(n) for n in keep}, products
        self.done: dict[int, Rows] = {}
        self.beside: dict[int, tuple[Rows, str] | None] = {}
        self.uses: Counter[int] = Counter()
        self.known: dict[int, Node] = {}  # holds on to nodes, as ids of dead ones come again
        self.numbers = count()

    def __call__(self, t: Node | Tensor) -> DataFrame:
        node = t.permuted().node if isinstance(t, Tensor) else t
        self._count(node)
        return self._rows(node).df(len(node.shape))

    def _count(self, node: Node) -> None:
        left = [node]
        while left:
            n = left.pop()
            if id(n) not in self.known:
                self.known[id(n)] = n
                self.uses.update(id(x) for x in n.inputs)
                left += n.inputs

    def _new(self, df: DataFrame, weight: int) -> Rows:
        """df: d0.., val."""
        name = f"v{next(self.numbers)}"
        return Rows(df.withColumnRenamed("val", name), name, (), weight)

    def _add(self, rows: Rows, column: Column) -> Rows:
        name = f"v{next(self.numbers)}"
        return replace(rows, val=name, steps=(*rows.steps, (name, column)))

    def _rows(self, node: Node) -> Rows:
        if id(node) not in self.done:
            rows = getattr(self, f"_{node.kind}")(node)
            if id(node) in self.keep:
                rows = self._new(rows.df(len(node.shape)).cache(), 0)
            self.done[id(node)] = rows
        return self.done[id(node)]

    def _taken(self, node: Node) -> tuple[DataFrame, int]:
        """For a join or the like, whose plan will have the node's plan in it. And its weight."""
        rows = self._rows(node)
        if self.uses[id(node)] > 1 and rows.weight > HEAVY:
            rows = self.done[id(node)] = self._formed(rows, len(node.shape))
        return rows.df(len(node.shape)), rows.weight

    def _formed(self, rows: Rows, rank: int) -> Rows:
        return self._new(materialize(rows.df(rank), "formed")[0], 0)

    def _formation(self, node: Node) -> Rows:
        return self._formed(self._rows(node.inputs[0]), len(node.shape))

    def _beside(self, node: Node) -> tuple[Rows, str] | None:
        """If an einsum's value, before aggregation, is a column beside one of its inputs: with it, and that input's labels."""
        if id(node) not in self.beside:
            self.beside[id(node)] = self._find_beside(node)
        return self.beside[id(node)]

    def _find_beside(self, node: Node) -> tuple[Rows, str] | None:
        spec = node.p["spec"]
        if spec.broadcast:
            return None
        for b, whole in enumerate(spec.terms):
            if set(whole) != set(spec.labels) or len(set(whole)) < len(whole):
                continue
            found = self._rows(node.inputs[b])
            steps, cols = dict(found.steps), []
            for x, term in zip(node.inputs, spec.terms, strict=True):
                rows = self._reduced(x, term, found.base, whole) if term != whole else self._rows(x)
                if rows is None or rows.base is not found.base:
                    break
                steps |= dict(rows.steps)
                cols.append(F.col(rows.val))
            else:
                merged = replace(found, steps=tuple(sorted(steps.items(), key=lambda s: int(s[0][1:]))))
                if node.p["join"].op == "hole":
                    return replace(merged, val=self._rows(node.inputs[b]).val), whole
                return self._add(merged, S.to_column(node.p["join"], cols, self.variables)), whole
        return None

    def _reduced(self, x: Node, term: str, base: DataFrame, whole: str) -> Rows | None:
        """x as a window over base, if it reduces what lies beside base to the labels in term."""
        if x.kind != "einsum" or not x.p["agg"] or x.dtype == S.COMPLEX or not (inner := self._beside(x)) or inner[0].base is not base:
            return None
        rows, labels = inner
        places = [labels.index(c) for c in x.p["spec"].out]
        if [whole[k] for k in places] != list(term) or prod(x.p["sizes"][c] for c in labels if c not in x.p["spec"].out) > ROW:
            return None
        over = Window.partitionBy(*(f"d{k}" for k in places))
        return self._add(rows, aggregate(x.p["agg"], x.dtype, F.col(rows.val), over))

    def _input(self, node: Node) -> Rows:
        df = node.p["df"]
        return self._new(df.select(*(F.col(k).cast("int") for k in keys(len(node.shape))), F.col("val").cast(S.SPARK[node.dtype])), 0)

    def _constant(self, node: Node) -> Rows:
        return self._new(grid(self.spark, node.shape).withColumn("val", literal(node.p["value"], node.dtype)), 0)

    def _lowertri(self, node: Node) -> Rows:
        p = node.p
        inside = F.col("d0") - p["start"] >= F.col("d1")
        return self._new(grid(self.spark, node.shape).withColumn("val", F.when(inside, literal(p["lower"], node.dtype)).otherwise(literal(p["upper"], node.dtype))), 0)

    def _einsum(self, node: Node) -> Rows:
        spec, agg = node.p["spec"], node.p["agg"]
        if self._by_blocks(node):
            return self._blocked(node)
        if beside := self._beside(node):
            rows, labels = beside
            if agg is None and spec.out == labels:
                return rows
            out = rows.whole().select(*(F.col(f"d{labels.index(c)}").alias(f"d{k}") for k, c in enumerate(spec.out)), F.col(rows.val).alias("val"))
            weight = rows.weight
        else:
            out, weight = self._joined(node)
        if agg is None:
            return self._new(out, weight)
        if spec.broadcast:
            return self._new(self._broadcast_sums(node, out), weight + 1)
        return self._new(out.groupBy(*keys(len(spec.out))).agg(aggregate(agg, node.dtype, F.col("val")).alias("val")), weight + 1)

    def _joined(self, node: Node) -> tuple[DataFrame, int]:
        spec = node.p["spec"]
        name = {c: f"l{k}" for k, c in enumerate(spec.labels)}
        joined, have, weight = None, set(), len(node.inputs) - 1
        left = [(i, t, x) for i, (t, x) in enumerate(zip(spec.terms, node.inputs, strict=True))]
        while left:  # in the given order, but what shares a label comes before what doesn't
            k = next((k for k, (_, t, _) in enumerate(left) if have & set(t)), 0)
            i, t, x = left.pop(k)
            df, own = self._taken(x)
            weight += own
            part = df.select(*(F.col(f"d{j}").alias(name[c]) for j, c in enumerate(t)), F.col("val").alias(f"v{i}"))
            if joined is None:
                joined = part
            else:
                on = [name[c] for c in t if c in have]
                joined = joined.join(part, on) if on else joined.crossJoin(part)
            have |= set(t)
        if spec.broadcast and node.p["agg"]:
            value = S.to_column(node.p["join"], [F.col(f"v{i}") for i in range(len(node.inputs))], self.variables)
            return joined.select(*(F.col(name[c]).alias(f"d{k}") for k, c in enumerate(spec.out) if c not in spec.broadcast), value.alias("val")), weight
        if spec.broadcast:
            new = grid(self.spark, tuple(node.p["sizes"][c] for c in spec.broadcast))
            joined = joined.crossJoin(new.select(*(F.col(f"d{k}").alias(name[c]) for k, c in enumerate(spec.broadcast))))
        value = S.to_column(node.p["join"], [F.col(f"v{i}") for i in range(len(node.inputs))], self.variables)
        return joined.select(*(F.col(name[c]).alias(f"d{k}") for k, c in enumerate(spec.out)), value.alias("val")), weight

    def _broadcast_sums(self, node: Node, out: DataFrame) -> DataFrame:
        """out: of the labels that inputs have. The aggregate, which is the same along the others, goes along these once it is taken."""
        spec = node.p["spec"]
        have = [f"d{k}" for k, c in enumerate(spec.out) if c not in spec.broadcast]
        found = out.groupBy(*have).agg(aggregate(node.p["agg"], node.dtype, F.col("val")).alias("val"), F.count(F.lit(1)).alias("n")).where("n > 0").drop("n")
        new = grid(self.spark, tuple(node.p["sizes"][c] for c in spec.broadcast))
        new = new.toDF(*(f"d{spec.out.index(c)}" for c in spec.broadcast))
        return new.crossJoin(found).select(*keys(len(spec.out)), "val")

    def _by_blocks(self, node: Node) -> bool:
        spec, d = node.p["spec"], node.dtype
        plain = node.p["agg"] == "add" and len(node.inputs) == 2 and d == "f64" and not spec.broadcast and node.p["join"] == S.mul(S.hole(0, d), S.hole(1, d))
        products = prod(node.p["sizes"].values())
        return plain and products >= self.products and products >= INTENSITY * sum(prod(x.shape) for x in node.inputs) and all(len(set(t)) == len(t) for t in spec.terms)

    def _blocked(self, node: Node) -> Rows:
        spec, sizes = node.p["spec"], node.p["sizes"]
        block = blocked.choose_blocks(spec, sizes)
        taken = [self._taken(x) for x in node.inputs]
        a, b = (blocked.to_blocks(df, x.shape, tuple(block[c] for c in t)) for (df, _), x, t in zip(taken, node.inputs, spec.terms, strict=True))
        return self._new(blocked.from_blocks(blocked.contract(spec, a, b)), sum(w for _, w in taken) + 4)

    def _select(self, node: Node) -> Rows:
        out, weight = None, 0
        for x, (begin, end, offset) in zip(node.inputs, node.p["boxes"], strict=True):
            df, own = self._taken(x)
            weight += own
            where, cols = F.lit(True), []
            for k, (b, e, o) in enumerate(zip(begin, end, offset, strict=True)):
                where &= (F.col(f"d{k}") >= b) & (F.col(f"d{k}") < e)
                cols.append((F.col(f"d{k}") + (o - b)).alias(f"d{k}"))
            part = df.where(where).select(*cols, "val")
            out = part if out is None else out.unionByName(part)
        return self._new(out, weight)

    def _pad(self, node: Node) -> Rows:
        ks = keys(len(node.shape))
        df, weight = self._taken(node.inputs[0])
        moved = df.select(*((F.col(k) + o).alias(k) for k, o in zip(ks, node.p["offset"], strict=True)), "val")
        return self._new(grid(self.spark, node.shape).join(moved, ks, "left").select(*ks, F.coalesce("val", literal(0, node.dtype)).alias("val")), weight + 1)

    def _to_complex(self, node: Node) -> Rows:
        *head, last = keys(len(node.shape))
        df, weight = self._taken(node.inputs[0])
        part = lambda k: F.max(F.when(F.col(last) % 2 == k, F.col("val")))
        half = df.groupBy(*head, F.expr(f"cast({last} div 2 as int)").alias("half")).agg(F.struct(part(0).alias("re"), part(1).alias("im")).alias("val"))
        return self._new(half.select(*head, F.col("half").alias(last), "val"), weight + 1)

    def _to_real(self, node: Node) -> Rows:
        *head, last = keys(len(node.shape))
        df, weight = self._taken(node.inputs[0])
        parts = df.select(*head, last, F.posexplode(F.array("val.re", "val.im")).alias("k", "v"))
        return self._new(parts.select(*head, (F.col(last) * 2 + F.col("k")).alias(last), F.col("v").alias("val")), weight)

    def _squeeze(self, node: Node) -> Rows:
        df, weight = self._taken(node.inputs[0])
        old = iter([f"d{k}" for k, n in enumerate(node.inputs[0].shape) if n != 1])
        cols = [F.lit(0).alias(f"d{k}") if n == 1 else F.col(next(old)).alias(f"d{k}") for k, n in enumerate(node.shape)]
        return self._new(df.select(*cols, "val"), weight)


def run(spark: SparkSession, saved: dict[str, Tensor | Node], variables: dict[str, float] | None = None, keep: list[Node] = ()) -> dict[str, DataFrame]:
    """The DataFrames of the tensors to be saved; shared nodes are lowered once."""
    low = Lowering(spark, variables, keep)
    for t in saved.values():
        low._count(t.permuted().node if isinstance(t, Tensor) else t)
    return {name: low(t) for name, t in saved.items()}


def to_numpy(df: DataFrame, shape: tuple[int, ...], dtype: str = "f64") -> np.ndarray:
    """A small tensor on the driver."""
    kind = {"f16": np.float16, "f32": np.float32, "f64": np.float64, "c64": np.complex64}[dtype]
    out = np.full(shape, np.nan, kind)
    rows = df.toArrow()
    at = tuple(rows[f"d{k}"].to_numpy() for k in range(len(shape)))
    v = rows["val"].combine_chunks()
    out[at] = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False) if dtype == S.COMPLEX else v.to_numpy(zero_copy_only=False)
    return out


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """A small tensor as rows."""
    place = [[int(x) for x in p] for p in np.ndindex(*a.shape)]
    if np.iscomplexobj(a):
        rows = [(*p, (float(a[tuple(p)].real), float(a[tuple(p)].imag))) for p in place]
        kind = "struct<re:float,im:float>"
    else:
        rows, kind = [(*p, float(a[tuple(p)])) for p in place], "double"
    return spark.createDataFrame(rows, ", ".join(f"{k} int" for k in keys(a.ndim)) + f", val {kind}")
