"""SimHash, exact dedup, packing and BPE against plain versions, on real and odd texts."""

import hashlib
import random
import zlib
from itertools import combinations

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tensorql.llm import _common, bpe, exact, packing, simhash

ODD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "one two",
    "One\tTWO\x0bthree\x0cfour\r\nfive",
    "a  b   c\n d \n e",
    " lead and trail ",
    "it's we'll I'VE don't 's 't 1234 12,5 ½ ²",
    "<|endoftext|> x<|endoftext|>y <|startoftext|>Z <|END",
    "Éé é İstanbul ΣΑΣ straße ﬁ",
    "no break em　wide \x1c\x1d sep\x1e\x1f \x85 nel ᠎ m ​ z",
    "日本語 テキスト 👩‍👩‍👧 🏳️‍🌈 한국어 한",
    "x" * 5000,
    "ab " * 3000,
    "the quick brown fox " * 400,
    "\x00 nul �",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(100_000 + i, t, "x") for i, t in enumerate(ODD + ODD[:6])], "doc_id long, text string, component_id string")
    return real.unionByName(odd, allowMissingColumns=True).repartition(3).cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = components(texts, [(a, b) for a, b in combinations(texts, 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = rows(simhash.near_duplicates(docs))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps


def test_links_are_those_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    got = _common.connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")))
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2])
    assert {**{x: x for x in fps}, **{r.node: r.root for r in got.collect()}} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(500, 500), (None, 3)], "u long, v long")
    assert {r.root for r in _common.connected_components(edges).collect()} == {0}
    assert _common.connected_components(edges.where("u is null")).count() == 0


def test_exact(spark, docs):
    want = {}
    for r in rows(docs):
        want.setdefault(r["text"] or "", []).append(r["doc_id"])
    for width in (exact.BLOCK, 64):
        got = rows(exact.exact_duplicates(docs, width=width))
        assert len(got) == docs.count()
        by_id = {r["doc_id"]: r for r in got}
        for text, ids in want.items():
            for d in ids:
                assert by_id[d] == {"doc_id": d, "keep_id": max(ids), "group_size": len(ids), "kept": d == max(ids), "text_sha256": hashlib.sha256(text.encode()).hexdigest()}


def test_exact_repeated_rows_and_null_ids(spark):
    long = "ab" * 5000
    data = spark.createDataFrame([(1, long), (1, long), (None, long), (1, "x"), (None, None), (None, "")], "doc_id long, text string")
    got = rows(exact.exact_duplicates(data))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == sorted(
        [("1", "1", 3, True), ("1", "1", 3, False), ("None", "1", 3, False), ("1", "1", 1, True), ("None", "None", 2, True), ("None", "None", 2, False)]
    )
    assert exact.exact_duplicates(data.where("false")).count() == 0


@pytest.mark.parametrize("most", [2, packing.OPEN])
def test_packing(spark, docs, most):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows(docs)}
    got = rows(packing.pack(docs, most=most, with_ids=True))
    have, sequences = {}, {}
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == ids and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))
        have.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert have.keys() == want.keys()
    for d, spans in [*have.items(), *sequences.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == len(want[d]) if spans is have.get(d) else at <= packing.WINDOW
    total = sum(map(len, want.values()))
    if most == packing.OPEN:
        assert len(sequences) * packing.WINDOW - total < 0.02 * total + packing.WINDOW


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.where("false")).count() == 0


def test_bpe(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    for r in rows(bpe.encode_decode(docs, with_ids=True)):
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids), texts[r["doc_id"]][:80]
        assert r["decoded"] == decoded
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_merge_takes_the_leftmost_of_the_lowest_rank():
    rng = random.Random(5)
    for _ in range(300):
        pairs, number = [], 2
        for r in range(12):
            pair = rng.randrange(number), rng.randrange(number)
            pairs.append(pair)
            number += 1
        ranks = {}
        for r, (a, b) in enumerate(pairs):
            ranks.setdefault(a << bpe.SHIFT | b, r)
        word = rng.choices([0, 1], k=rng.randint(1, 40))
        want = list(word)
        while found := [(ranks[a << bpe.SHIFT | b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << bpe.SHIFT | b in ranks]:
            r, i = min(found)
            want[i : i + 2] = [2 + r]
        assert bpe.merge(word, ranks, 2) == want


def test_round_trip_to_text():
    b = bpe.load(bpe.default_path())
    assert b.decode_text(b.encode("Hello, wörld  42 日本")) == "hello , wörld 4 2 日本"
