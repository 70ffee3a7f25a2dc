"""Index-label expressions such as "ij,jk->ik": parsing, validation, classes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    terms: tuple[str, ...]
    out: str

    @staticmethod
    def parse(text: str) -> Spec:
        text = text.replace(" ", "")
        if text.count("->") != 1:
            raise ValueError(f"{text}: one -> is needed")
        left, out = text.split("->")
        terms = tuple(left.split(","))
        for t in (*terms, out):
            if not t:
                raise ValueError(f"{text}: empty term; a scalar has the shape [1]")
            if len(set(t)) != len(t):
                raise ValueError(f"{text}: a label stands twice in {t}; diagonals aren't taken")
        return Spec(terms, out)

    def __str__(self) -> str:
        return f"{','.join(self.terms)}->{self.out}"

    @property
    def labels(self) -> str:
        """Output labels, then aggregated ones as first seen."""
        return self.out + "".join(dict.fromkeys(c for t in self.terms for c in t if c not in self.out))

    @property
    def aggregated(self) -> str:
        return self.labels[len(self.out) :]

    @property
    def broadcast(self) -> str:
        """Output labels of no input."""
        return "".join(c for c in self.out if not any(c in t for t in self.terms))

    def sizes(self, shapes: list[tuple[int, ...]], out_shape: tuple[int, ...] | None = None) -> dict[str, int]:
        """The size of each label. There is no stretching of size 1."""
        found: dict[str, int] = {}
        for t, shape in zip((*self.terms, self.out), (*shapes, out_shape), strict=True):
            if shape is None:
                continue
            if len(t) != len(shape):
                raise ValueError(f"{t} does not fit the shape {shape}")
            for c, n in zip(t, shape, strict=True):
                if found.setdefault(c, n) != n:
                    raise ValueError(f"label {c} is {found[c]} and {n}")
        if missing := [c for c in self.out if c not in found]:
            raise ValueError(f"sizes of broadcast labels {missing} aren't given")
        return found

    def classify(self) -> str:
        """identity, straight, permutation, aggregation, broadcast, outer, contraction or join."""
        if len(self.terms) == 1:
            t = self.terms[0]
            if self.broadcast:
                return "broadcast"
            if t == self.out:
                return "identity"
            return "permutation" if set(t) == set(self.out) else "aggregation"
        if all(t == self.out for t in self.terms):
            return "straight"
        if len(self.terms) == 2:
            shared = set(self.terms[0]) & set(self.terms[1])
            if not shared:
                return "outer"
            if self.aggregated and set(self.aggregated) <= shared:
                return "contraction"
        return "join"

    def normalized(self) -> Spec:
        """The same with labels a, b, .. in the order of the output, then of the aggregated ones."""
        new = {c: chr(97 + k) for k, c in enumerate(self.labels)}
        of = lambda t: "".join(new[c] for c in t)
        return Spec(tuple(map(of, self.terms)), of(self.out))

    def without_broadcast(self) -> Spec:
        """The output without the labels that no input has."""
        return Spec(self.terms, "".join(c for c in self.out if c not in self.broadcast))

    @staticmethod
    def matmul(transpose_left: bool = False, transpose_right: bool = False) -> Spec:
        return Spec(("ji" if transpose_left else "ij", "kj" if transpose_right else "jk"), "ik")
