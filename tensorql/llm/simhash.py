"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 2 or fewer differing bits share at least one variant within 1 bit of
both. So each distinct fingerprint emits itself and its 64 one-bit neighbours, the variants
are shuffled, and whatever meets at a variant is linked. Fingerprints are distinct before
they emit, so at most 65 can meet at one variant (those within 1 bit of it), whatever the
size of a group of copies; all of them are within 2 bits of each other, so links to the
least of them keep the components whole without emitting pairs.

Defined results: null or empty text has no words, so fingerprint 0, linked like any other.
Repeated rows stay repeated. A null doc_id gets its row, and never names a component unless
all members' ids are null. Columns other than the id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C
from ._links import linked

BITS = 64
#: near_copies(): words of a shingle and similarity; fingerprints of a text and bits of each.
WIDTH, SIMILAR = 5, 0.8
TABLES, NARROW = 6, 40
#: Candidates that differ in more of all these bits are not verified. A text without a fifth of its words differs in 36 of 240 on average.
FAR = 60


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of ASCII-lower-cased word shingles; bit set if set in over half of the hashes. Signed."""
    words = text.lower().split()  # bytes: lower() is A-Z only, split() takes exactly \x20 \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = digest(b" ".join(words), seed)
        return h - (1 << BITS) if h >> (BITS - 1) else h
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 8192 + 1):
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp (signed long)."""
    C.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t or b"") for t in texts], pa.int64())], ["id", "fp"]
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def ball(distinct_fps: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct_fps: (fp, more). Every variant of fp within 1 bit as `variant`; those that more than one fingerprint emits under the same `more`."""
    more = [c for c in distinct_fps.columns if c != "fp"]
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(bits)))
    emitted = distinct_fps.select("*", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    at = Window.partitionBy(*more, "variant")  # at most bits + 1 rows: those within 1 bit of the variant
    met = emitted.withColumn("least", F.min("fp").over(at)).withColumn("most", F.max("fp").over(at))
    return met.where("least <> most").drop("most")


def links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) between distinct fingerprints: each met at a variant, linked to the least met there."""
    if radius not in (1, 2):
        raise ValueError("ball hashing is laid out for a radius of 1 or 2: variants within 1 bit")
    met = ball(distinct_fps.select("fp")).where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return met.distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (least id reachable) for every row of docs."""
    fps, _ = C.materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = C.connected_components(links(by_fp.select("fp"), radius))
    rooted = by_fp.join(roots, by_fp.fp == roots.node, "left").select(
        by_fp.fp, "least_id", F.coalesce("root", by_fp.fp).alias("root")
    )
    rooted, _ = C.materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp", "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the ASCII-lower-cased shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if n > 1 else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, n))


def word_fingerprints(text: bytes) -> list[int]:
    """TABLES SimHashes of NARROW bits each of a text's words; a word counts by the root of how often it occurs."""
    counts = Counter(text.lower().split())
    if not counts:
        return [0] * TABLES
    weights, sums = np.floor(64 * np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))), np.zeros(256)
    words = list(counts)
    for at in range(0, len(words), 4096):
        part = words[at : at + 4096]
        digests = b"".join([xxhash.xxh3_128_digest(w) + xxhash.xxh3_128_digest(w, 1) for w in part])
        # Whole numbers below 2^53, so the sums are exact in any order.
        sums += weights[at : at + len(part)] @ np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 32), axis=1).astype(np.float64)
    bits = (2 * sums > weights.sum())[: TABLES * NARROW].reshape(TABLES, NARROW)
    return [int(b @ (1 << np.arange(NARROW, dtype=np.int64))) for b in bits]


def _numbered(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, str]:
    """Written: all columns of docs as c0, c1, .., and row (its number), id, place (128-bit hash of the set of shingles), size (of it), fps."""
    C.ship(docs.sparkSession)
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    own = own.withColumn("id", F.col(f"c{docs.columns.index(id_col)}")).withColumn("scanned", F.col(f"c{docs.columns.index(text_col)}"))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
                sets = [shingle_set(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.columns[:-1],
                        pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                        pa.array(list(map(len, sets)), pa.int32()),
                        pa.array([word_fingerprints(t) for t in texts], pa.list_(pa.int64())),
                    ],
                    [*b.schema.names[:-1], "place", "size", "fps"],
                )

    kept = own.drop("scanned").schema.add("place", T.BinaryType()).add("size", T.IntegerType()).add("fps", T.ArrayType(T.LongType()))
    return C.materialize(own.mapInArrow(run, kept).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _components(each: DataFrame, text: str, similar: float, width: int) -> DataFrame:
    """each: written by _numbered. (place, node, root): equal sets are one node, named by its least row."""
    spark = each.sparkSession
    nodes, nodes_path = C.materialize(
        each.groupBy("place").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("fps").alias("fps")), "nodes"
    )
    # a set of n shingles is as similar to another only if that has n * similar or more
    searched = nodes.where(F.floor(F.col("size") / similar + 1e-9) > F.col("size")).select("node", "size", F.posexplode("fps").alias("t", "fp"))
    met = ball(searched.select("t", "fp").distinct(), NARROW).select("t", "fp", F.xxhash64("t", "variant").alias("key"))
    alike = searched.groupBy("t", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "fp", F.xxhash64(F.lit("same"), "t", "fp").alias("key"))
    keyed = searched.join(met.unionByName(alike), ["t", "fp"]).select("key", F.col("node").alias("id"), "size")

    def verify(pairs: DataFrame) -> DataFrame:
        of = lambda p: nodes.select(F.col("node").alias(p), F.col("fps").alias(f"{p}_fps"))
        apart = " + ".join(f"bit_count(u_fps[{k}] ^ v_fps[{k}])" for k in range(TABLES))
        pairs, pairs_path = C.materialize(pairs.join(of("u"), "u").join(of("v"), "v").where(f"{apart} <= {FAR}").select("u", "v"), "near-pairs")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()

        def run(batches):
            for whole in batches:
                for at in range(0, len(whole), 256):
                    b = whole.slice(at, 256)
                    sets = [shingle_set(t or b"", width).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["row", "hashes"])

        sets, sets_path = C.materialize(each.join(wanted, "row", "left_semi").select("row", text).mapInArrow(run, "row long, hashes array<bigint>"), "sets")
        side = lambda p, n: sets.select(F.col("row").alias(p), F.col("hashes").alias(n))
        both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").withColumn("n", F.size(F.array_intersect("a", "b")))
        found, _ = C.materialize(both.where(F.col("n") >= similar * (F.size("a") + F.size("b") - F.col("n")) - 1e-9).select("u", "v"), "verified")
        C.discard(spark, pairs_path)
        C.discard(spark, sets_path)
        return found

    like = lambda a, b: F.least(f"{a}.size", f"{b}.size") >= similar * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    roots = linked(keyed, like, verify).withColumnRenamed("node", "of")
    out, _ = C.materialize(nodes.join(roots, nodes.node == roots.of, "left").select("place", "node", F.coalesce("root", "node").alias("root")), "rooted")
    C.discard(spark, nodes_path)
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str, similar: float, width: int) -> tuple[DataFrame, DataFrame, str]:
    """The numbered table; (place, best): of the group of a place the row with the least id, of several the first; path."""
    each, path = _numbered(docs, id_col, text_col, width)
    rooted = _components(each, f"c{docs.columns.index(text_col)}", similar, width)
    least = each.groupBy("place").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("best"))
    placed = rooted.join(least, "place")
    named = placed.groupBy("root").agg(F.min("best").alias("best"))
    return each, placed.select("place", "root").join(named, "root").select("place", "best"), path


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDTH) -> DataFrame:
    """doc_id, component_id for every row of docs: near copies by the Jaccard similarity of their sets of shingles.

    Candidates come by ball hashing as above, of TABLES narrow fingerprints of the words instead
    of one of shingles: a word changes one feature of those, but `width` features of a SimHash
    of shingles, which would put most near copies out of reach. Each pair of candidates is
    verified by its exact similarity or connected by others (_links.py). Equal sets are one node.
    """
    each, of_place, _ = _grouped(docs, id_col, text_col, similar, width)
    return each.select("id", "place").join(of_place, "place").select(F.col("id").alias("doc_id"), F.col("best.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDTH) -> DataFrame:
    """docs with one row of each group of near copies: that with the least id, of several the first. All columns stay."""
    each, of_place, _ = _grouped(docs, id_col, text_col, similar, width)
    gone, _ = C.materialize(each.select("row", "place").join(of_place, "place").where("row <> best.row").select("row"), "gone")
    return each.join(gone, "row", "left_anti").select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
