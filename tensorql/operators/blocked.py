"""Blocked tensors: rows of block positions and a flat array each, contracted by vectorised kernels.

A blocked relation has columns b0, b1, .. (block position) and blk array<double>, row-major.
Blocks are uniform; the last one of a dimension may be short. Results are those of the
one-value-a-row layout up to the order of additions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorql.plans.spec import Spec


@dataclass(frozen=True)
class Blocked:
    df: DataFrame
    shape: tuple[int, ...]
    block: tuple[int, ...]

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(ceil(n / b) for n, b in zip(self.shape, self.block, strict=True))

    def extent(self, at) -> tuple[int, ...]:
        return tuple(min(b, n - k * b) for k, n, b in zip(at, self.shape, self.block, strict=True))


def choose_block(shape: tuple[int, ...], most: int = 1 << 16) -> tuple[int, ...]:
    """Halves the largest side until a block has at most so many values."""
    block = list(shape)
    while prod(block) > most:
        k = block.index(max(block))
        block[k] = ceil(block[k] / 2)
    return tuple(block)


def choose_blocks(spec: Spec, sizes: dict[str, int], most: int = 1 << 15) -> dict[str, int]:
    """Of each label; the longest is halved until no block of a term or of the result has more values."""
    block = {c: sizes[c] for c in spec.labels}
    while longest := [t for t in (*spec.terms, spec.out) if prod(block[c] for c in t) > most]:
        c = max(longest[0], key=block.__getitem__)
        block[c] = ceil(block[c] / 2)
    return block


def spans(total: int, parts: int) -> list[int]:
    """Sizes of parts that differ by one at most, the larger ones later."""
    return [total * (k + 1) // parts - total * k // parts for k in range(parts)]


def to_blocks(df: DataFrame, shape: tuple[int, ...], block: tuple[int, ...] | None = None) -> Blocked:
    """From one value a row. A block is gathered in one group: its size is the block's."""
    block = block or choose_block(shape)
    rank = len(shape)
    b = [F.expr(f"cast(d{k} div {n} as int)").alias(f"b{k}") for k, n in enumerate(block)]
    place = F.lit(0)
    for k, n in enumerate(block):  # strides follow the block's own extent
        place = place * F.least(F.lit(n), F.lit(shape[k]) - F.expr(f"cast(d{k} div {n} as int)") * n) + F.col(f"d{k}") % n
    rows = df.select(*b, F.struct(place.alias("p"), F.col("val").cast("double").alias("v")).alias("x"))
    out = rows.groupBy(*(f"b{k}" for k in range(rank))).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("blk"))
    return Blocked(out, tuple(shape), tuple(block))


def from_blocks(x: Blocked) -> DataFrame:
    """One value a row."""
    rows = x.df.select(*(f"b{k}" for k in range(len(x.shape))), F.posexplode("blk").alias("p", "val"))
    rest, cols = F.col("p"), []
    for k in range(len(x.shape) - 1, -1, -1):
        extent = F.least(F.lit(x.block[k]), F.lit(x.shape[k]) - F.col(f"b{k}") * x.block[k])
        cols.insert(0, (F.col(f"b{k}") * x.block[k] + (rest % extent)).cast("int").alias(f"d{k}"))
        rest = F.floor(rest / extent)
    return rows.select(*cols, "val")


def reblock(x: Blocked, block: tuple[int, ...]) -> Blocked:
    return x if tuple(block) == x.block else to_blocks(from_blocks(x), x.shape, block)


def contract(spec: str | Spec, a: Blocked, b: Blocked, held: int = 1 << 22) -> Blocked:
    """Sum of products over blocks: join on shared block labels, multiply block by block, add up block by block.

    Each task adds up what it multiplies, holding partial sums of `held` values at most, so that
    only sums are shuffled to their output block. There they are added in the order of the rows.
    """
    s = Spec.parse(spec) if isinstance(spec, str) else spec
    sizes = s.sizes([a.shape, b.shape])
    block = {}
    for t, x in zip(s.terms, (a, b), strict=True):
        for c, n in zip(t, x.block, strict=True):
            if block.setdefault(c, n) != n:
                raise ValueError(f"label {c} is blocked by {block[c]} and {n}: reblock first")
    name = {c: f"l{k}" for k, c in enumerate(s.labels)}
    side = lambda x, t, v: x.df.select(*(F.col(f"b{k}").alias(name[c]) for k, c in enumerate(t)), F.col("blk").alias(v))
    left, right = side(a, s.terms[0], "x"), side(b, s.terms[1], "y")
    on = [name[c] for c in s.terms[0] if c in s.terms[1]]
    pairs = left.join(right, on) if on else left.crossJoin(right)
    labels, terms, target, rank = s.labels, s.terms, s.out, len(s.out)  # plain strings: workers may not have this package
    out = [f"b{k}" for k in range(rank)]
    letter = {c: chr(97 + k) for k, c in enumerate(labels)}  # einsum takes letters only
    pattern = f"{''.join(letter[c] for c in terms[0])},{''.join(letter[c] for c in terms[1])}->{''.join(letter[c] for c in s.out)}"
    fields = [*out, "blk"]

    def rows(sums):
        keys = [pa.array([k[i] for k in sums], pa.int32()) for i in range(rank)]
        offsets = np.cumsum([0, *(v.size for v in sums.values())]).astype(np.int32)
        flat = np.concatenate([v.ravel() for v in sums.values()])
        return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], fields)

    def multiply(batches):
        sums, size = {}, 0
        for batch in batches:
            places = list(zip(*(batch[name[c]].to_pylist() for c in labels), strict=True))
            xs, ys = batch["x"], batch["y"]
            for i, at in enumerate(places):
                place = dict(zip(labels, at, strict=True))
                shape = lambda t: tuple(min(block[c], sizes[c] - place[c] * block[c]) for c in t)  # noqa: E731, B023
                x = xs[i].values.to_numpy().reshape(shape(terms[0]))
                y = ys[i].values.to_numpy().reshape(shape(terms[1]))
                part = np.einsum(pattern, x, y, optimize=True)
                key = tuple(place[c] for c in target)
                if key in sums:
                    sums[key] = sums[key] + part
                else:
                    sums[key] = part
                    size += part.size
                if size >= held:
                    yield rows(sums)
                    sums, size = {}, 0
        if sums:
            yield rows(sums)

    def add(batches):
        key, total = None, None
        for batch in batches:
            for i, this in enumerate(zip(*(batch[c].to_pylist() for c in out), strict=True)):
                part = batch["blk"][i].values.to_numpy()
                if this != key:
                    if key is not None:
                        yield rows({key: total})
                    key, total = this, part
                else:
                    total = total + part
        if key is not None:
            yield rows({key: total})

    schema = ", ".join(f"{c} int" for c in out) + ", blk array<double>"
    partial = pairs.select(*(name[c] for c in labels), "x", "y").mapInArrow(multiply, schema)
    summed = partial.repartition(*out).sortWithinPartitions(*out).mapInArrow(add, schema)
    return Blocked(summed, tuple(sizes[c] for c in s.out), tuple(block[c] for c in s.out))
