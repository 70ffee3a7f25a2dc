"""The queries opN_<name> as such, and plain versions of scoring."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorql.llm import bpe, exact, gam, packing, perplexity, simhash, toxicity


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1(spark, sf, texts):
    got = rows(simhash.op1_simhash_near_dedup(spark, sf))
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r["fingerprint"] == format(simhash.fingerprint(texts[d].encode()) % (1 << 64), "016x")
    fps = {d: int(r["fingerprint"], 16) for d, r in got.items()}
    for d in fps:
        assert got[d]["component_id"] == min(got[e]["component_id"] for e in fps if (fps[d] ^ fps[e]).bit_count() <= 2) <= d


def test_op2_and_op3(spark, sf, texts):
    pieces = packing.op2_packing(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == texts.keys()
    per = {}
    for p in pieces:
        per.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
    for found in per.values():
        found.sort()
        assert [s for s, _, _ in found] == list(np.cumsum([0, *(n for _, n, _ in found)])[:-1]) and sum(n for _, n, _ in found) == found[0][2]
    got = rows(bpe.op3_bpe_encode_decode(spark, sf))
    assert got.keys() == texts.keys() and all(len(r["ids_sha256"]) == len(r["decoded_sha256"]) == 64 for r in got.values())


def test_op5(spark, sf, texts):
    got = rows(toxicity.op5_toxicity(spark, sf))
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_toxicity_by_plain_windows():
    """Scores of whole texts, one window and one step at a time."""
    net = toxicity.Network(5)
    net.odds = np.random.default_rng(0).standard_normal(toxicity.ODDS).astype(np.float32)
    net.slope = np.array([0.7, -0.2])
    texts = ["", "one", " ".join(f"word{k % 37}" for k in range(150)), "a b c " * 30]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(a, u):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in a:
            m = h @ u
            z, r = sigmoid(x[:8] + m[:8]), sigmoid(x[8:16] + m[8:16])
            n = np.tanh(x[16:] + r * m[16:])
            h = (1 - z) * n + z * h
            out.append(h)
        return np.array(out)

    def window(words):
        x = net.inputs(toxicity.prepare(words)).astype(float) if words else np.zeros((0, toxicity.INPUTS))
        pad = np.zeros((toxicity.WINDOW - len(words), 24))
        a0, a1 = (np.concatenate([x @ net.p[f"w{i}"] + net.p[f"b{i}"], pad]) for i in "01")
        h = np.concatenate([run(a0, net.p["u0"]), run(a1[::-1], net.p["u1"])[::-1]], 1)
        e = np.exp(np.tanh(h @ net.p["wa"]) @ net.p["va"])
        return float((e / e.sum()) @ h @ net.p["wo"] + net.p["bo"][0])

    want = []
    for t in texts:
        words = t.lower().split()
        best = max(window(words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(words)))
        want.append(sigmoid(0.7 * best - 0.2))
    assert toxicity.HIDDEN == 8
    np.testing.assert_allclose(toxicity.score_texts(net, toxicity.Vocabulary(net), texts), want, rtol=1e-4)
    np.testing.assert_allclose(toxicity.score_texts(net, toxicity.Vocabulary(net), texts, most=3), want, rtol=1e-4)


def test_scores_do_not_depend_on_a_full_table(monkeypatch):
    net = toxicity.Network(2)
    texts = [" ".join(f"w{k}x{i}" for k in range(60)) for i in range(20)]
    whole = toxicity.score_texts(net, toxicity.Vocabulary(net), texts)
    monkeypatch.setattr(toxicity, "KEEP", 50)
    monkeypatch.setattr(toxicity, "GROUP", 100)
    np.testing.assert_allclose(toxicity.score_texts(net, toxicity.Vocabulary(net), texts), whole, rtol=1e-5)


def test_op7(spark, sf, texts):
    got = rows(exact.op7_exact_dedup(spark, sf))
    same = {}
    for d, t in texts.items():
        same.setdefault(t, []).append(d)
    for t, ds in same.items():
        for d in ds:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ds), len(ds), d == max(ds), hashlib.sha256(t.encode()).hexdigest())


def test_blocks_of_one_digest(monkeypatch):
    """Should two blocks share a digest, naming starts anew."""
    monkeypatch.setattr(exact.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    batch = exact.pa.RecordBatch.from_arrays([exact.pa.array([b"d", b"d", b"d", b"e"]), exact.pa.array([b"a", b"a", b"b", b"a"])], ["digest", "block"])
    found = list(exact._name([batch]))
    got = [r for b in found for r in b.to_pylist()]
    assert [(r["digest"], r["clash"]) for r in got] == [(b"d", True), (b"d", True), (b"e", False)] and len({r["name"] for r in got}) == 3
    assert exact.xxhash.xxh3_128_digest(b"x", 0) != exact.xxhash.xxh3_128_digest(b"x", 1)


def test_op8(spark, sf, texts):
    got = rows(perplexity.op8_quality_rules(spark, sf))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for d, r in got.items():
        words = word.findall(texts[d])
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
        if often is not None:
            cover = {k + x for k, w in enumerate(windows) if w in often for x in range(3)}
            assert r["n_repeat_words"] == len(cover)
        seen, dup = set(), 0
        for line in texts[d].split("\n"):
            dup += line in seen
            if word.search(line):
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[d])), dup)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words)) and not (r["kept"] and r["base_failed"])


def test_bands_reject_on_both_sides(spark):
    """Among ordinary prose, a text too predictable and one too surprising."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(300)]
    docs = [(k, "en", " ".join(rng.choice(vocabulary, 120))) for k in range(300)]
    docs += [(1000, "en", " ".join(["the tin of the", *(f"tin {'a' * k} of" for k in range(60, 100))])), (1001, "en", " ".join("".join(rng.choice(list("etaoinshrdlu"), 6)) for _ in range(60)))]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = rows(perplexity.quality_rules(df))
    assert got[1000]["log_ppl"] < got[1000]["low"] and got[1001]["log_ppl"] > got[1001]["high"] and not got[1000]["base_failed"]
    assert not got[1000]["kept"] and not got[1001]["kept"] and sum(got[k]["kept"] for k in range(300)) == 300
    joined = rows(perplexity.quality_rules(df, array_rows=0))
    assert all(joined[k]["kept"] == r["kept"] and abs(joined[k]["log_ppl"] - r["log_ppl"]) < 1e-9 for k, r in got.items())


def test_op10_and_plain_bins(spark, sf, texts):
    got = rows(gam.op10_quality_classifier(spark, sf))
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    rng = np.random.default_rng(0)
    x = rng.random((200, len(gam.NAMES))).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.9).astype(float)
    model = gam.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [sum(row[j] >= c for c in cuts) for j, cuts in enumerate(model.cuts)]
        logit = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        logit += sum(t[bins[i] * gam.COARSE // gam.BINS][bins[j] * gam.COARSE // gam.BINS] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9


@pytest.mark.parametrize("op", ["op5", "op8", "op10", "op1", "op3"])
def test_empty_tables(spark, op):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    found = {
        "op1": lambda: simhash.near_duplicates(empty), "op8": lambda: perplexity.quality_rules(empty), "op10": lambda: gam.quality(empty, labels),
        "op5": lambda: toxicity.toxicity(empty, toxicity.train(empty, labels)), "op3": lambda: bpe.encode_decode(empty) if hasattr(bpe, "encode_decode") else empty,
    }[op]()
    assert found.count() == 0


def test_caches_are_bounded_and_other_files_go_through_the_library(spark, monkeypatch, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["some words here and there", "x" * 2000 + " then more words", "zwölf Boxkämpfer jagen", "a  b\n c", *(f"word{k} of{k} text" for k in range(50))]
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "KEEP_BYTES", 200)
    fast = packing.ByteBpe(path)
    for _ in range(3):
        for k in range(0, len(texts), 9):
            got = fast(texts[k : k + 9])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[k : k + 9]]
    assert max(map(len, fast.seen)) <= packing.LONG
    spec = json.load(open(path))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, want = packing.ByteBpe(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert [np.frombuffer(g, "<u4").tolist() for g in other(texts)] == [want.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "KEEP_CHARS", 100)
    word = bpe.WordBpe(bpe.default_path())
    want = Tokenizer.from_file(bpe.default_path())
    for t in texts:
        assert [int(i) for r in word.runs(t) for i in word.lookup(r)[0].split()] == want.encode(t, add_special_tokens=False).ids
    assert max(map(len, word.seen), default=0) <= bpe.LONG
