"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input at each word: a learned vector of the word (hashed), the mean of learned vectors of its
character trigrams (hashed), how much likelier the word is in toxic training documents, and
the same for the likeliest of its beginnings of 4 to 6 characters.
A gated recurrent unit runs over each window of words in either direction; attention pools its
states into one logit. Windows overlap by a quarter and cover the whole text; a document's score
comes from its highest window through a fitted logistic.

Documents are labelled, windows are not: in each epoch a toxic document teaches with its
highest window, and others with their highest and some more. Training runs on the driver over
a bounded sample of labelled rows (TRAIN_ROWS, the first by a hash of the id). These likelihoods are cross-fitted in two halves, so that no
training document sees counts of itself.

Defined results: null text counts as empty; a text without words is one window of padding.
Without labelled rows of both kinds, every score is the share of label 1 (0 without rows).
Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .gam import bucket

TRAIN_ROWS = 3_000
WINDOW, STRIDE = 32, 24
WORDS, TRIGRAMS, ODDS = 4096, 4096, 1 << 18
BEGINNINGS = (4, 5, 6)
INPUTS = 14
DIM, HIDDEN = 6, 8
EPOCHS, BATCH, RATE = 6, 256, 0.01
THRESHOLD = 0.3
#: Words that a worker keeps prepared, 192 bytes each besides the word; when full, the table starts anew.
KEEP = 60_000
#: Characters of texts that are taken together.
GROUP = 200_000
MARKS = "".join(c for c in map(chr, range(33, 256)) if not c.isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Prepared(NamedTuple):
    """Places of words in the tables: their own, of odds (word, then beginnings), of trigrams (all words', one after the other)."""

    word: np.ndarray
    odds: np.ndarray
    tri: np.ndarray
    size: np.ndarray
    begin: np.ndarray


def prepare(words: list[str], most: int = 20_000) -> Prepared:
    if len(words) > most:  # temporary arrays stay small
        parts = [prepare(words[i : i + most]) for i in range(0, len(words), most)]
        word, odds, tri, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
        return Prepared(word, odds, tri, size, np.cumsum(size) - size)
    bare = [w.strip(MARKS) for w in words]
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in bare), np.int64, len(bare))
    length = np.fromiter(map(len, bare), np.int64, len(bare)) + 2
    start = np.cumsum(length) - length
    codes = np.frombuffer("".join([f"^{w}$" for w in bare]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    odds = [own >> 7]
    h = np.zeros(len(bare), np.uint64)
    for k in range(max(BEGINNINGS) + 1):  # the character before the word counts as the first
        on = k < length
        h[on] = (h[on] * np.uint64(0x9E3779B1) + codes[start[on] + k]) & np.uint64(0xFFFFFFFFFFFF)
        if k in BEGINNINGS:
            odds.append((h >> np.uint64(11)).astype(np.int64) + k)
    size = np.maximum(1, length - 2)
    begin = np.cumsum(size) - size
    at = np.repeat(start - begin, size) + np.arange(size.sum())
    pad = np.concatenate([codes, np.zeros(2, np.uint64)])
    tri = (pad[at] * np.uint64(0x9E3779B1) + pad[at + 1] * np.uint64(0x85EBCA77) + pad[at + 2] * np.uint64(0xC2B2AE3D)) >> np.uint64(9)
    return Prepared(own % WORDS, (np.stack(odds, 1) % ODDS).astype(np.int32), (tri % np.uint64(TRIGRAMS)).astype(np.int32), size, begin)


def window_starts(n: int) -> list[int]:
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run_gru(a: np.ndarray, u: np.ndarray, keep: bool = False):
    """a: inputs times weights (steps, windows, 3 * HIDDEN), gates z, r, n. States of all steps, and what backward() needs."""
    h = np.zeros((a.shape[1], HIDDEN), np.float32)
    out, tape = np.empty((*a.shape[:2], HIDDEN), np.float32), []
    for t in range(len(a)):
        m = h @ u
        zr = _sigmoid(a[t, :, : 2 * HIDDEN] + m[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[t, :, 2 * HIDDEN :] + r * m[:, 2 * HIDDEN :])
        if keep:
            tape.append((h, z, r, n, m[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out, tape


def _back_gru(d_out: np.ndarray, tape, u: np.ndarray):
    d_a, d_u = np.empty((*d_out.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, n, mn = tape[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (h - n) * z * (1 - z)
        d_r = d_n * mn * r * (1 - r)
        d_a[t] = np.concatenate([d_z, d_r, d_n], 1)
        d_m = np.concatenate([d_z, d_r, d_n * r], 1)
        d_u += h.T @ d_m
        d_h = d_h * z + d_m @ u.T
    return d_a, d_u


class Network:
    """params: word, tri (tables), w0, b0, u0 and w1, b1, u1 (a direction each), wa, va (attention), wo, bo (logit)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
        d = INPUTS
        self.p = {
            "word": draw(WORDS, DIM), "tri": draw(TRIGRAMS, DIM), "wa": draw(2 * HIDDEN, HIDDEN, k=0.4), "va": draw(HIDDEN, k=0.4),
            "wo": draw(2 * HIDDEN, k=0.4), "bo": np.zeros(1, np.float32),
        }
        for i in "01":
            self.p |= {f"w{i}": draw(d, 3 * HIDDEN, k=0.3), f"u{i}": draw(HIDDEN, 3 * HIDDEN, k=0.3), f"b{i}": np.zeros(3 * HIDDEN, np.float32)}
        self.odds = np.zeros(ODDS, np.float32)
        self.slope = np.array([1.0, 0.0])
        self.constant: float | None = None

    def inputs(self, w: Prepared, odds: np.ndarray | None = None) -> np.ndarray:
        """A row for each word."""
        if not len(w.word):
            return np.zeros((0, INPUTS), np.float32)
        o = (self.odds if odds is None else odds)[w.odds]
        chars = np.add.reduceat(self.p["tri"][w.tri], w.begin, axis=0) / w.size[:, None]
        return np.concatenate([self.p["word"][w.word], chars, o[:, :1], o[:, 1:].max(1, keepdims=True)], 1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs times weights of both directions; the last row is padding, which adds nothing."""
        both = np.concatenate([x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]], 1)
        return np.concatenate([both, np.zeros((1, 6 * HIDDEN), np.float32)])

    def forward(self, a: np.ndarray, keep: bool = False):
        """a: (steps, windows, 6 * HIDDEN). A logit for each window."""
        p = self.p
        h0, t0 = _run_gru(a[:, :, : 3 * HIDDEN], p["u0"], keep)
        h1, t1 = _run_gru(a[::-1, :, 3 * HIDDEN :], p["u1"], keep)
        h = np.concatenate([h0, h1[::-1]], 2)
        k = np.tanh(h @ p["wa"])
        e = k @ p["va"]
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        c = (e[:, :, None] * h).sum(0)
        logit = c @ p["wo"] + p["bo"][0]
        return (logit, (t0, t1, h, k, e, c)) if keep else logit

    def backward(self, d_logit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        t0, t1, h, k, e, c = kept
        p, g = self.p, {}
        g["wo"], g["bo"] = c.T @ d_logit, d_logit.sum(keepdims=True)
        d_c = d_logit[:, None] * p["wo"]
        d_e = (h * d_c).sum(2)
        d_s = e * (d_e - (e * d_e).sum(0))
        d_k = d_s[:, :, None] * p["va"] * (1 - k * k)
        g["va"] = (k * d_s[:, :, None]).sum((0, 1))
        g["wa"] = np.einsum("twi,twj->ij", h, d_k)
        d_h = e[:, :, None] * d_c + d_k @ p["wa"].T
        d_a0, g["u0"] = _back_gru(d_h[:, :, :HIDDEN], t0, p["u0"])
        d_a1, g["u1"] = _back_gru(d_h[::-1, :, HIDDEN:], t1, p["u1"])
        return g, np.concatenate([d_a0, d_a1[::-1]], 2)


class Vocabulary:
    """Numbers of words, with their projected inputs; for scoring. Row -1 is padding. When full, the table starts anew."""

    def __init__(self, net: Network):
        self.net, self.place = net, {}
        self.rows = np.zeros((KEEP + 1, 6 * HIDDEN), np.float32)

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > KEEP:
            self.place, new = {}, list(words)
            size = max(KEEP, len(new)) + 1  # one text alone may have more
            if size != len(self.rows):
                self.rows = np.zeros((size, 6 * HIDDEN), np.float32)
        for i in range(0, len(new), 5_000):
            part, at = new[i : i + 5_000], len(self.place)
            self.rows[at : at + len(part)] = self.net.projected(self.net.inputs(prepare(part)))[:-1]
            self.place.update(zip(part, range(at, at + len(part)), strict=True))


def _windows(ids: np.ndarray, pad: int) -> np.ndarray:
    """(WINDOW, number of windows): word numbers, padded at the end."""
    starts = np.array(window_starts(len(ids)))
    full = np.full(starts[-1] + WINDOW, pad, np.int32)
    full[: len(ids)] = ids
    return full[starts[None, :] + np.arange(WINDOW)[:, None]]


def score_texts(net: Network, vocabulary: Vocabulary, texts: list[str], most: int = 2048) -> np.ndarray:
    """Scores of whole texts. Words are split and windows are held for some texts at a time."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    best = np.full(len(texts), -np.inf)
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        size += len(text)
        if size >= GROUP or i == len(texts) - 1:
            split = [words_of(texts[k]) for k in group]
            vocabulary.add(set().union(*split))
            place = vocabulary.place
            held = [_windows(np.fromiter(map(place.__getitem__, words), np.int32, len(words)), -1) for words in split]
            owner = np.repeat(group, [w.shape[1] for w in held])
            del split
            ids = np.concatenate(held, 1)
            for k in range(0, len(owner), most):
                np.maximum.at(best, owner[k : k + most], net.forward(vocabulary.rows[ids[:, k : k + most]]))
            group, size = [], 0
    return _sigmoid(net.slope[0] * best + net.slope[1])


def _odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Shrunk log ratio of the shares of toxic and other documents that have a word."""
    has = np.zeros((2, ODDS))
    for s, label in zip(docs, y, strict=True):
        has[int(label), s] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()]).reshape(2, 1)
    p = (has + 1) / (n + 2)
    seen = has.sum(0)
    return (np.log(p[1] / p[0]) * seen / (seen + 10)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Deterministic for the same texts in the same order."""
    net = Network(seed)
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    prepared = prepare(list(vocabulary))
    pad = len(vocabulary)
    del vocabulary
    sets = [np.unique(prepared.odds[np.unique(i)]) for i in ids]
    half = np.arange(len(y)) % 2
    cross = [_odds([s for s, k in zip(sets, half, strict=True) if k != f], y[half != f]) for f in (0, 1)]
    net.odds = _odds(sets, y)
    windows = [_windows(i, pad) for i in ids]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rate = {k: RATE * (0.1 if k in ("word", "tri") else 1.0) for k in net.p}  # tables learn words by heart if let
    step = 0

    def some(which: np.ndarray) -> Prepared:
        size = prepared.size[which]
        begin = np.cumsum(size) - size
        tri = prepared.tri[np.repeat(prepared.begin[which] - begin, size) + np.arange(size.sum())]
        return Prepared(prepared.word[which], prepared.odds[which], tri, size, begin)

    def project(odds: np.ndarray, most: int = 20_000) -> np.ndarray:
        table = np.zeros((pad + 1, 6 * HIDDEN), np.float32)
        for i in range(0, pad, most):
            part = np.arange(i, min(pad, i + most))
            table[part] = net.projected(net.inputs(some(part), odds))[:-1]
        return table

    def logits(which: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(which)
        for f in (0, 1):
            table = project(cross[f])
            own = [k for k, d in enumerate(which) if half[d] == f]
            for at in range(0, len(own), 64):
                part = own[at : at + 64]
                n = [windows[which[k]].shape[1] for k in part]
                got = net.forward(table[np.concatenate([windows[which[k]] for k in part], 1)])
                for k, v in zip(part, np.split(got, np.cumsum(n)[:-1]), strict=True):
                    out[k] = v
        return out

    likely = [np.concatenate([cross[f][prepared.odds].max(1), [0]]) for f in (0, 1)]
    for epoch in range(epochs):
        if epoch == 0:  # before anything is learned: the window with the likeliest words
            top = []
            for d in range(len(y)):
                top.append(np.maximum(likely[half[d]][windows[d]], 0).sum(0))
        else:
            top = logits(np.arange(len(y)))
        # Labels have errors: a toxic document whose best window still looks clean late in training teaches no more.
        doubt = (y == 1) & (np.array([t.max() for t in top]) < 0) if epoch >= 3 else np.zeros(len(y), bool)
        chosen, target, fold = [], [], []
        for d in np.flatnonzero(~doubt):
            best = int(np.argmax(top[d]))
            picks = {best} if y[d] else {best, *rng.integers(0, windows[d].shape[1], 2).tolist()}
            for k in sorted(picks):
                chosen.append(windows[d][:, k])
                target.append(y[d])
                fold.append(half[d])
        chosen, target, fold = np.stack(chosen, 1), np.array(target, np.float32), np.array(fold)
        weight = np.where(target == 1, len(target) / max(1, 2 * target.sum()), len(target) / (2 * max(1, (1 - target).sum()))).astype(np.float32)
        for f in rng.permutation(2):
            own = rng.permutation(np.flatnonzero(fold == f))
            for at in range(0, len(own), BATCH):
                part = own[at : at + BATCH]
                w, where = np.unique(chosen[:, part], return_inverse=True)
                where = where.reshape(WINDOW, len(part))
                real = w[w < pad]
                own_words = some(real)
                x = np.concatenate([net.inputs(own_words, cross[f]), np.zeros((len(w) - len(real), INPUTS), np.float32)])
                a = np.concatenate([x @ net.p["w0"] + net.p["b0"], x @ net.p["w1"] + net.p["b1"]], 1)
                a[len(real) :] = 0
                logit, kept = net.forward(a[where], True)
                g, d_a = net.backward(((_sigmoid(logit) - target[part]) * weight[part] / len(part)).astype(np.float32), kept)
                d_rows = np.zeros_like(a)
                np.add.at(d_rows, where.ravel(), d_a.reshape(-1, 6 * HIDDEN))
                d_rows[len(real) :] = 0
                d_x = np.zeros_like(x)
                for i, cols in (("0", slice(0, 3 * HIDDEN)), ("1", slice(3 * HIDDEN, None))):
                    g[f"w{i}"], g[f"b{i}"] = x.T @ d_rows[:, cols], d_rows[:, cols].sum(0)
                    d_x += d_rows[:, cols] @ net.p[f"w{i}"].T
                g["word"], g["tri"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["tri"])
                np.add.at(g["word"], own_words.word, d_x[: len(real), :DIM])
                np.add.at(g["tri"], own_words.tri, np.repeat(d_x[: len(real), DIM : 2 * DIM] / own_words.size[:, None], own_words.size, axis=0))
                step += 1
                for k, v in net.p.items():  # Adam
                    m, s = moments[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v -= (rate[k] * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    best = np.array([v.max() for v in logits(np.arange(len(y)))])
    slope = np.array([1.0, 0.0])
    for _ in range(200):  # logistic on the highest logits, lightly held to the slope 1
        p = _sigmoid(slope[0] * best + slope[1])
        r, w = p - y, p * (1 - p) + 1e-6
        grad = np.array([(r * best).sum() + slope[0] - 1.0, r.sum()])
        curve = np.array([[(w * best * best).sum() + 1.0, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(curve, grad)
        slope = slope - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    net.slope = slope
    return net


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network:
    """docs (doc_id, text), labels (doc_id, label). At most train_rows whole texts come to the driver."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    wanted = F.broadcast(labels.orderBy(*order).limit(train_rows))  # at most train_rows ids, so they may go to all
    rows = docs.join(wanted, "doc_id").select("doc_id", "text", "label").orderBy(*order, "text").limit(train_rows).toArrow()
    y = rows["label"].to_numpy().astype(np.float64)
    texts = [t or "" for t in rows["text"].to_pylist()]
    del rows
    return fit(texts, y)


def _scores(net: Network, column: int):
    """Of Arrow batches: pieces of them, with the scores of the texts in a column."""

    def run(batches):
        vocabulary = Vocabulary(net)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                yield b, score_texts(net, vocabulary, [t or "" for t in b.column(column).to_pylist()])

    return run


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of docs."""
    C.ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the tables' sizes are constants

    def run(batches):
        for b, s in _scores(sent.value, 1)(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay."""
    C.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b, s in _scores(sent.value, column)(batches):
            yield b.filter(pa.array(s < threshold))

    column = docs.columns.index(text_col)
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # a name may have a dot, which mapInArrow doesn't take
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket(4) != 2)
    return labels.select("doc_id", F.col("toxic").alias("label"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.select("doc_id", "text"), training_labels(spark, sf_dir))
    return toxicity(docs, net).select(
        "doc_id", (bucket(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
