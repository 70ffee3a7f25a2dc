"""Perplexity rules against a plain Kneser-Ney model; both classifiers by held-out labels."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tensorql.llm import gam, perplexity, toxicity

DOCS = [
    (1, "the cat sat on the mat. " * 4, "en"),
    (2, "the dog ran to the cat", "EN"),
    (3, None, None),
    (4, "", "xx-long"),
    (5, "a b c a b c a b c\n\nline one\nline one\n \nline one\r", "de"),
    (6, "éü 日本 \U0001f600 12 345\ttab", "de"),
    (7, " ".join(f"w{i}" for i in range(80)) + " # * | <x>", "en"),
    (7, " ".join(f"w{i}" for i in range(80)) + " # * | <x>", "en"),
    (None, "no id here", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).repartition(3)


def symbols(text):
    out = []
    for c in text or "":
        o = min(ord(c), 0xFFFF)
        out.append(" " if c in "\t\n\x0b\x0c\r" else "0" if c in "0123456789" else chr(o))
    return ["^"] * 3 + out + ["^"]


def plain_model(texts):
    counts = {4: Counter()}
    for t in texts:
        s = symbols(t)
        counts[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {}
    for k in (1, 2, 3, 4):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = {j: max(0.1, min(j - (j + 1) * y * (n[j + 1] / n[j] if n[j] else 0), 0.95 * j)) for j in (1, 2, 3)}
        total, taken = defaultdict(float), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3)]
        p[k] = {}
        for g, c in counts[k].items():
            lower = 1 / (len(counts[1]) + 1) if k == 1 else p[k - 1][g[1:]]
            p[k][g] = (c - d[min(c, 3)] + taken[g[:-1]] * lower) / total[g[:-1]]
    return p[4]


def test_perplexity(docs):
    by_lang = defaultdict(list)
    code = lambda x: x.lower() if re.fullmatch("[a-zA-Z]{2,3}", x or "") else "und"
    for _, t, lang in DOCS:
        by_lang[code(lang)].append(t)
    models = {lang: plain_model(ts) for lang, ts in by_lang.items()}
    want = defaultdict(list)
    for d, t, lang in DOCS:
        s = symbols(t)
        grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
        want[d].append(-sum(math.log(models[code(lang)][g]) for g in grams) / len(grams))
    for rows in (perplexity.ARRAY_ROWS, 0):  # sent to the workers, and joined
        got = perplexity.quality_rules(docs, array_rows=rows).collect()
        assert len(got) == len(DOCS)
        for r in got:
            assert r["log_ppl"] == pytest.approx(want[r["doc_id"]][0], rel=1e-4), r["doc_id"]


def test_model_sums_to_one(docs):
    table = perplexity.model(docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).where("lang = 'de'"))[0].toPandas()
    table["context"] = table.key.to_numpy().view(np.uint64) >> np.uint64(16)
    assert np.exp(table.logp).groupby(table.context).sum().max() <= 1.0001


def test_base_counts(spark, sf):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _, t in [*((d, t) for d, t, _ in DOCS), *real]:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        assert perplexity.base(t) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))


def test_verdicts(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"the cat number {i * k} sat on the mat" for k in range(20)), "en") for i in range(60)]
    bad = [(100, "".join(rng.choices([*map(chr, range(33, 123)), *" " * 20], k=1500)), "en"), (101, "too short", "en"), (102, "same words here " * 50, "en")]
    got = {r["doc_id"]: r for r in perplexity.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(60)) and not any(got[i]["kept"] for i in (100, 101, 102))
    assert not got[100]["base_failed"] and got[101]["base_failed"] and got[102]["base_failed"]


def auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > n).mean() + 0.5 * (a == n).mean() for a in p])


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = gam.op10_quality_classifier(spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(got) == pd.read_parquet(f"{sf}/documents.parquet").shape[0] and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_held_out():
    sf = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").query("lang == 'en'").head(900)
    half = np.arange(len(rows)) % 2 == 0
    net = toxicity.fit(list(rows.text[half]), rows.toxic[half].to_numpy().astype(float), epochs=4)
    s = toxicity.score_texts(net, toxicity.Vocabulary(net), list(rows.text[~half]))
    assert auc(rows.toxic[~half].to_numpy(), s) > 0.85


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    a = (rng.standard_normal((5, 4, 6 * toxicity.HIDDEN)) * 0.5).astype(np.float32)
    w = rng.standard_normal(4).astype(np.float32)
    logit, kept = net.forward(a, True)
    g, d_a = net.backward(w, kept)
    for name in ("u0", "u1", "wa", "va", "wo"):
        p = net.p[name]
        at = np.unravel_index(1, p.shape)
        old, h = p[at], 1e-2
        p[at] = old + h
        up = net.forward(a) @ w
        p[at] = old - h
        down = net.forward(a) @ w
        p[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-3), name
    b = a.copy()
    b[2, 1, 5] += 1e-2
    up = net.forward(b) @ w
    b[2, 1, 5] -= 2e-2
    assert d_a[2, 1, 5] == pytest.approx((up - net.forward(b) @ w) / 2e-2, rel=0.05, abs=2e-3)


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_odd_texts_are_scored(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!! ..."), (None, "a" * 5000), (3, "x " * 3000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1)], "doc_id long, label int")
    net = toxicity.train(docs.select("doc_id", "text"), labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs, net).collect())
    assert all(0 <= r["score"] <= 1 for r in gam.quality(docs, labels).collect())
    assert toxicity.drop_toxic(docs, net, threshold=2.0).columns == docs.columns
    nothing = toxicity.train(docs.select("doc_id", "text"), labels.where("false"))
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}
    assert gam.quality(docs.where("false"), labels).count() == 0
