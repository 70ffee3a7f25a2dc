"""The pipeline's near-dedup finds near copies of 0.8 and more, against all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from tensorql.llm import simhash

from .test_dedup_pack_encode import components


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies(spark):
    rng = random.Random(5)
    texts = [None, "", "one two", "One  two", "one two three"]
    for n in (60, 200, 500):
        for changed in (0, 1, 2, 5, 10, 30):
            a = [str(rng.random()) for _ in range(n)]
            b = list(a)
            for k in rng.sample(range(n), changed):
                b[k] = "changed"
            texts += [" ".join(a), " ".join(b)]
    sets = {d: plain(t) for d, t in enumerate(texts)}
    near = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(sets, near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == want
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, "").collect()}
    assert kept == {d for d, c in want.items() if d == c}


def test_odd_tables(spark):
    """Null ids, repeated rows, names that clash or have dots, no rows."""
    a, b = " ".join(map(str, range(100))), " ".join(map(str, range(100, 200)))
    rows = [(None, a), (None, a), (7, a), (7, a), (8, b), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "1 as row", "text", "2 as `a.b`", "'x' as place")
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(7, a), (8, b), (9, None)]
    assert simhash.drop_near_copies(df.where("false")).count() == 0
