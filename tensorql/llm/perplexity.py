"""Quality rules with an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of 4-grams of characters for each language,
counted by Spark over every document: tasks count their own 4-grams, the counts are summed by
key, and continuation counts, discounts and interpolated probabilities of all orders are
aggregations and joins over that table. Scoring looks up 4-grams in sorted hash arrays (key,
log probability). The table grows with the input; where it has up to ARRAY_ROWS rows, a number
known before it is used, the arrays are sent to the workers once; beyond, documents' 4-grams
are joined with it instead, with the same result.

A 4-gram's key holds its four symbols in 16 bits each, so keys don't collide. Symbols are code
points; digits are one symbol, white space is one, and so are all code points above U+FFFF.

The bands hold documents of 50 words or more between quartiles of log perplexity of their
language, widened by WIDE times the distance of the quartiles; outside, they are rejected.

Defined results: null text has no words. Languages are codes of two or three letters; null or
anything else is 'und'. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WIDE = 4.0
#: 16 bytes a row: 64 MB.
ARRAY_ROWS = 4_000_000
#: Distinct 4-grams that a task holds before it emits their counts.
HOLD = 2_000_000
#: Stands between texts.
EDGE = ""


def _classes() -> np.ndarray:
    """The symbol of each code point up to U+FFFF."""
    table = np.arange(1 << 16, dtype=np.uint64)
    table[0] = 1
    for c in "\t\n\x0b\x0c\r":
        table[ord(c)] = ord(" ")
    for c in "123456789":
        table[ord(c)] = ord("0")
    table[ord(EDGE)] = 0
    return table


CLASSES = _classes()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams of all texts one after the other, and where each text's begin. A text of n characters has n + 1."""
    joined = "".join([f"{EDGE * 3}{t}{EDGE}" for t in texts]).encode("utf-32-le", "replace")
    a = CLASSES[np.minimum(np.frombuffer(joined, np.uint32), 0xFFFF)]
    keys = (a[:-3] << np.uint64(48)) | (a[1:-2] << np.uint64(32)) | (a[2:-1] << np.uint64(16)) | a[3:]
    sizes = np.array([len(t) + 4 for t in texts])
    ends = np.cumsum(sizes)
    own = np.ones(ends[-1], bool)
    for k in (1, 2, 3):  # 4-grams that would reach into the next text
        own[ends - k] = False
    return keys[own[: len(keys)]], np.concatenate([[0], np.cumsum(sizes - 3)[:-1]])


def _batches_by_language(batch, most: int = 4_000_000):
    """(language, row numbers, texts) with up to about `most` characters."""
    by: dict[str, list] = {}
    for i, (lang, text) in enumerate(zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True)):
        by.setdefault(lang, []).append((i, text or ""))
    for lang, items in by.items():
        part, size = [], 0
        for item in items:
            part.append(item)
            size += len(item[1])
            if size >= most:
                yield lang, *map(list, zip(*part, strict=True))
                part, size = [], 0
        if part:
            yield lang, *map(list, zip(*part, strict=True))


def _count(batches):
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])
        held.clear()

    for b in batches:
        for lang, _, texts in _batches_by_language(b):
            keys, n = np.unique(grams(texts)[0], return_counts=True)
            if lang in held:
                both, where = np.unique(np.concatenate([held[lang][0], keys]), return_inverse=True)
                keys, n = both, np.bincount(where, np.concatenate([held[lang][1], n]), len(both)).astype(np.int64)
            held[lang] = keys, n.astype(np.int64)
        if sum(len(k) for k, _ in held.values()) > HOLD:
            yield from out()
    yield from out()


def _discounted(counts: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """counts: (lang, key, c) of one order; lower: (lang, key, p) of the order below. Returns (lang, key, p)."""
    n = lambda k: F.count_if(F.col("c") == k).cast("double")
    of = counts.groupBy("lang").agg(*(n(k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count(F.lit(1)).alias("types"))
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.coalesce(F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.0))
        of = of.withColumn(f"d{k}", F.greatest(F.lit(0.1), F.least(d, F.lit(0.95 * k))))
    # One row for each language, of which there are 26^2 + 26^3 + 1 at most.
    own = counts.join(F.broadcast(of.select("lang", "d1", "d2", "d3", "types")), "lang").select(
        "lang", "key", "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"), "types", F.shiftrightunsigned("key", 16).alias("context")
    )
    contexts = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
    own = own.join(contexts, ["lang", "context"])
    rest = F.col("taken") / F.col("total")
    p = (F.col("c") - F.col("d")) / F.col("total")
    if lower is None:
        return own.select("lang", "key", (p + rest / (F.col("types") + 1)).alias("p"))
    own = own.withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1)))
    below = lower.select("lang", F.col("key").alias("shorter"), F.col("p").alias("lower_p"))
    return own.join(below, ["lang", "shorter"]).select("lang", "key", (p + rest * F.col("lower_p")).alias("p"))


def model(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs: (lang, text). The table (lang, key, logp) of all 4-grams, and its number of rows."""
    C.ship(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(_count, "lang string, key long, n long")
    counts, _ = C.materialize(counted.groupBy("lang", "key").agg(F.sum("n").alias("c")), "grams")
    orders = {4: counts}
    for k in (3, 2, 1):  # how many different symbols come before: continuation counts
        shorter = F.col("key").bitwiseAND(F.lit((1 << (16 * k)) - 1))
        orders[k] = orders[k + 1].groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("c"))
    p = None
    for k in (1, 2, 3, 4):
        p = _discounted(orders[k], k, p)
    table, _ = C.materialize(p.select("lang", "key", F.log("p").cast("float").alias("logp")), "model")
    return table, table.count()


def arrays(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sorted arrays of each language: keys (unsigned), log probabilities."""
    got = table.toArrow()
    langs, keys, logp = got["lang"].combine_chunks(), got["key"].to_numpy().view(np.uint64), got["logp"].to_numpy()
    codes = langs.dictionary_encode()
    where, out = codes.indices.to_numpy(), {}
    for k, lang in enumerate(codes.dictionary.to_pylist()):
        own = np.flatnonzero(where == k)
        own = own[np.argsort(keys[own])]
        out[lang] = keys[own], logp[own].astype(np.float64)
    return out


def look_up(model_of: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Log probabilities; what the model hasn't seen gets its least."""
    known, logp = model_of
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, logp[at], logp.min())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes: \x20 \x09-\x0D only
    n = len(words)
    word_chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeated = 0
    if n >= 4:
        place: dict[bytes, int] = {}
        ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
        m = len(place) + 1
        pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        _, where, counts = np.unique(pairs[:-1].astype(np.int64) * m + ids[2:], return_inverse=True, return_counts=True)
        hit = counts[where] > 1
        cover = np.zeros(n, bool)
        cover[:-2] |= hit
        cover[1:-1] |= hit
        cover[2:] |= hit
        repeated = int(cover.sum())
    return n, word_chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _score(sent, kind):
    def run(batches):
        by_lang = sent.value if sent else None
        for b in batches:
            texts = b["text"].to_pylist()
            stats = [base(t or "") for t in texts]
            cols = [b["doc_id"], b["lang"], *(pa.array(c, pa.int64()) for c in (zip(*stats, strict=True) if stats else [[]] * 5))]
            log_ppl = np.zeros(len(texts))
            if by_lang:
                for lang, rows, part in _batches_by_language(b):
                    keys, begin = grams(part)
                    log_ppl[rows] = -np.add.reduceat(look_up(by_lang[lang], keys), begin) / (np.array([len(t) for t in part]) + 1)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(log_ppl)], [str(i) for i in range(8)])

    return run


def _spread(batches, most: int = 1 << 18):
    """Every document's distinct 4-grams, for the join with a model too large to send. Batches of about `most` rows."""
    held, size = [], 0

    def out():
        row, lang, keys, n = zip(*held, strict=True)
        sizes = list(map(len, keys))
        langs = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(lang)), sizes), pa.int32()), pa.array(lang)).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(row, np.int64), sizes)), langs, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(n))], ["row", "lang", "key", "n"]
        )

    for b in batches:
        ids = b["row"].to_numpy()
        for lang, rows, texts in _batches_by_language(b):
            for i, t in zip(rows, texts, strict=True):
                keys, n = np.unique(grams([t])[0], return_counts=True)
                held.append((ids[i], lang, keys, n))
                size += len(keys)
                if size >= most:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def perplexities(docs: DataFrame, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """docs: (doc_id, lang, text). Per row doc_id, lang, the base counts and log_ppl."""
    spark = docs.sparkSession
    C.ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table, rows = model(docs)
    schema = f"doc_id {kind}, lang string, {BASE}, log_ppl double"
    if rows <= array_rows:
        sent = spark.sparkContext.broadcast(arrays(table)) if rows else None
        return docs.mapInArrow(_score(sent, kind), schema)
    numbered, _ = C.materialize(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spread = numbered.select("row", "lang", "text").mapInArrow(_spread, "row long, lang string, key long, n long")
    sums = spread.join(table, ["lang", "key"]).groupBy("row").agg((-F.sum(F.col("n") * F.col("logp").cast("double")) / F.sum("n")).alias("joined"))
    kept = numbered.select(F.struct("doc_id", "row").alias("doc_id"), "lang", "text").mapInArrow(
        _score(None, kind), f"doc_id struct<doc_id:{kind},row:long>, lang string, {BASE}, log_ppl double"
    )
    kept = kept.withColumn("row", F.col("doc_id.row")).withColumn("doc_id", F.col("doc_id.doc_id")).drop("log_ppl")
    return kept.join(sums, "row", "left").select("doc_id", "lang", *(c.split()[0] for c in BASE.split(", ")), F.col("joined").alias("log_ppl"))


def quartiles(scored: DataFrame) -> DataFrame:
    """(lang, q1, q3) of log_ppl: the least thousandths that a quarter and three quarters of the values are at or below.

    Counted by thousandths, so the result is the same in whatever order tasks end. Perplexities
    are of 65,536 symbols at most, so a language has at most some ten thousand counts.
    """
    counts = scored.groupBy("lang", F.ceil(F.col("log_ppl") * 1000).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("lang")
    seen = counts.withColumn("below", F.sum("n").over(of.orderBy("at"))).withColumn("all", F.sum("n").over(of))
    least = lambda share: F.min(F.when(F.col("below") >= share * F.col("all"), F.col("at"))) / 1000.0
    return seen.groupBy("lang").agg(least(0.25).alias("q1"), least(0.75).alias("q3"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", wide: float = WIDE, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, log_ppl, low, high (the band), kept for every row of docs."""
    code = F.lower(F.col(lang_col))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    scored, _ = C.materialize(perplexities(own, array_rows), "perplexities")
    bands = quartiles(scored.where(f"n_words >= {MIN_WORDS}"))
    bands = bands.select("lang", (F.col("q1") - wide * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + wide * (F.col("q3") - F.col("q1"))).alias("high"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Bands: one row for each language code.
    return scored.join(F.broadcast(bands), "lang", "left").select(
        *scored.columns, "low", "high", failed.alias("base_failed"), F.coalesce(~failed & F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False)).alias("kept")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(c.split()[0] for c in BASE.split(", ")), "base_failed", "kept", (F.round("log_ppl", 6) + 0.0).alias("log_ppl"))
