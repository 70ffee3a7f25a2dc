"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a table with one value for each of its bins, and each chosen pair
of features a table over coarser bins of both. The tables are learned by cyclic boosting: in
every round each feature (then each pair) gets one shallow tree fitted to the gradient of the
log loss, added to its table with a small rate. Scoring is a bin search and an addition for
each table, over whole batches.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, the first by a hash of
the id); features are of whole texts of all documents.

Defined results: null text counts as empty, which has its own feature values and is scored
like any other. Without labelled rows of both kinds, every score is the share of label 1 (0.5
without rows). Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

TRAIN_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.15
THRESHOLD = 0.3
NAMES = (
    "log_words", "word_length", "long_words", "distinct_words", "repeat_words", "symbols", "upper", "digits", "punctuation",
    "marks", "bars", "lines_per_word", "dup_lines", "words_with_symbol", "non_ascii", "ends", "commonest",
)
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOL_WORD = re.compile(r"[^\s\w][^\s\w]")


def features(text: str) -> list[float]:
    """Of a whole text, in the order of NAMES."""
    words = text.split()
    n, chars = len(words), len(text) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m = max(1, n)
    pairs = list(zip(words, words[1:], strict=False))
    letters = sum(map(len, words))
    count = lambda s: sum(map(text.count, s)) / chars
    return [
        np.log1p(n),
        letters / m,
        sum(c for w, c in counts.items() if len(w) > 15) / m,
        len(counts) / m**0.8,
        1 - len(set(pairs)) / max(1, len(pairs)),
        count("#*$%&|<>"),
        len(UPPER.findall(text)) / chars,
        count("0123456789"),
        count(".,"),
        count("!?"),
        count("|"),
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        len(SYMBOL_WORD.findall(text)) / m,
        1 - len(text.encode("ascii", "ignore")) / chars,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        max(counts.values(), default=0) / m,
    ]


class Gam(NamedTuple):
    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    #: (first feature, second, table over COARSE x COARSE bins)
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        out = np.full(len(x), self.base)
        for t, b in zip(self.tables, bins, strict=True):
            out += t[b]
        for i, j, t in self.pairs:
            out += t[bins[i] * COARSE // BINS, bins[j] * COARSE // BINS]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The best tree of up to 2^depth leaves on sums of gradient and curvature by bin: the value of each bin."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g * _leaf(left_g, left_h) + right_g * _leaf(right_g, right_h)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() * _leaf(g.sum(), h.sum()) + 1e-12:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut on each axis: four leaves with the largest gain, and that gain."""
    best, cg, ch = (-1.0, np.zeros_like(g)), g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(len(g) - 1):
        for j in range(len(g) - 1):
            qg = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            qh = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((qg * _leaf(qg, qh)).sum())
            if gain > best[0]:
                v = _leaf(qg, qh)
                t = np.empty_like(g)
                t[: i + 1, : j + 1], t[: i + 1, j + 1 :], t[i + 1 :, : j + 1], t[i + 1 :, j + 1 :] = v
                best = gain, t
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Deterministic: no draw of chance is involved."""
    d = len(NAMES)
    share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Gam(base, [np.zeros(0)] * d, [np.zeros(1)] * d, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables, f = [np.zeros(len(c) + 1) for c in cuts], np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            tables[j] += step
            f += step[bins[j]]
    coarse = [b * COARSE // BINS for b in bins]
    grid = lambda i, j, v: np.bincount(coarse[i] * COARSE + coarse[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slopes()
    ranked = sorted(combinations(range(d), 2), key=lambda ij: (-_pair_tree(grid(*ij, g), grid(*ij, h))[0], ij))
    pairs = [(i, j, np.zeros((COARSE, COARSE))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            t += step
            f += step[coarse[i], coarse[j]]
    return Gam(base, cuts, tables, pairs)


def feature_table(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). (doc_id, x array<float>) per row."""
    C.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")


def bucket(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, labels (doc_id, label 0/1; those to learn from). (doc_id, score) per row of docs."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table, _ = C.materialize(feature_table(own), "features")
    labels = labels.where("doc_id is not null and label is not null")
    sample = labels.join(table, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows).select("x", "label").toArrow()
    x = np.array(sample["x"].to_pylist(), np.float32).reshape(-1, len(NAMES))
    gam = fit(x, sample["label"].to_numpy().astype(np.float64))

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gam.score(x))], ["doc_id", "score"])

    return table.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket(5) != 0)
    scored = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.select("doc_id", F.col("quality").alias("label")))
    return scored.select("doc_id", (bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
