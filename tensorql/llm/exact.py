"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Each distinct block gets one integer
name; then adjacent pairs of names are named in turn, level by level, until each document has
one name. Two documents have the same (level, name) if and only if their texts are the same
bytes: blocks are named by their bytes. A 128-bit digest only carries the names back to where
a block occurs; should two blocks ever share one, naming starts anew with other digests.

Distinct blocks meet, sorted, in one task each; where they occur is a row each, which the joins
that bring names back may split where a block or a pair is hot. No list of places is gathered.

Defined results: null text counts as empty; all empty texts are one group. Repeated rows are
members of their group; a null id never wins against another id.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import count

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

BLOCK = 4096
#: Names of one task start this far from those of the next.
TASK = 1 << 36


def _blocks(text: bytes | None, width: int) -> list[bytes]:
    return [text[k : k + width] for k in range(0, len(text), width)] if text else [b""]


def _places(width: int, seed: int):
    """(row, doc, text) to (row, doc, sha, pos, blocks, digest); doc and sha (of the text) at the first block only."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                blocks = _blocks(text, width)
                for pos, block in enumerate(blocks):
                    for column, value in zip(out, (i, None if pos else i, None if pos else hashlib.sha256(text or b"").digest(), pos, len(blocks), xxhash.xxh3_128_digest(block, seed)), strict=True):
                        column.append(value)
            at, first = pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(first), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())],
                ["row", "doc", "sha", "pos", "blocks", "digest"],
            )

    return run


def _cut(width: int, seed: int):
    """(text) to the distinct (digest, block) of a batch."""

    def run(batches):
        for b in batches:
            found = {block for text in b.column(0).cast(pa.binary()).to_pylist() for block in _blocks(text, width)}
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x, seed) for x in found], pa.binary()), pa.array(list(found), pa.binary())], ["digest", "block"])

    return run


def _name(batches):
    """Names blocks sorted by (digest, block): the number of the task, then the rank within it. clash: its digest has another block too."""
    name, held = TaskContext.get().partitionId() * TASK - 1, []  # held: the distinct blocks of one digest, with their names
    for b in batches:
        out = []
        for d, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and held[-1][:2] == (d, block):
                continue
            if held and held[-1][0] != d:
                out += held
                held = []
            name += 1
            held.append((d, block, name))
        yield _named(out)
    yield _named(held)


def _named(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
    digests = [d for d, _, _ in rows]
    clash = [n for n, d in Counter(digests).items() if d > 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array([n for _, _, n in rows], pa.int64()), pa.array([d in clash for d in digests], pa.bool_())], ["digest", "name", "clash"]
    )


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BLOCK) -> DataFrame:
    """(row, doc, sha, pos, blocks, name) for each block; doc and sha (of the text) at the first block only.

    row numbers the rows of docs, as ids may repeat. The result must be written once before it is used twice.
    """
    spark = docs.sparkSession
    C.ship(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"row long, doc {docs.schema[id_col].dataType.simpleString()}, sha binary, pos int, blocks int, digest binary"
    for seed in count():
        cut = docs.select(F.col(text_col).alias("text")).mapInArrow(_cut(width, seed), "digest binary, block binary")
        met = cut.repartition("digest").sortWithinPartitions("digest", "block")
        names, _ = C.materialize(met.mapInArrow(_name, "digest binary, name long, clash boolean"), "block-names")
        if names.where("clash").isEmpty():
            break
    places, _ = C.materialize(rows.mapInArrow(_places(width, seed), schema), "places")
    return places.join(names, "digest").select("row", "doc", "sha", "pos", "blocks", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BLOCK) -> DataFrame:
    """(row, doc, sha, level, name) for each row of docs: (level, name) is its collision-free identity."""
    level, _ = C.materialize(block_names(docs, id_col, text_col, width), "blocks")
    named = lambda k: level.where("blocks = 1").select("row", "doc", "sha", F.lit(k).alias("level"), "name")
    out = named(0)
    longest = level.agg(F.max("blocks")).first()[0] or 1
    for k in range(1, (longest - 1).bit_length() + 1):
        even = F.col("pos") % 2 == 0
        pairs = (
            level.where("blocks > 1")
            .groupBy("row", F.expr("int(pos div 2)").alias("pos"), F.expr("int((blocks + 1) div 2)").alias("blocks"))
            .agg(
                F.max("doc").alias("doc"),
                F.max("sha").alias("sha"),
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
            )
        )
        pairs, path = C.materialize(pairs, "pairs")
        names = pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b")
        names, names_path = C.materialize(names.select("a", "b", F.monotonically_increasing_id().alias("name")), "names")
        level, _ = C.materialize(pairs.join(names, ["a", "b"]).select("row", "doc", "sha", "pos", "blocks", "name"), "level")
        C.discard(docs.sparkSession, path)
        C.discard(docs.sparkSession, names_path)
        out = out.unionByName(named(k))
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs, dropped ones too.

    Of equal texts the row with the largest id stays; of repeated rows with that id, one.
    """
    ids, _ = C.materialize(identities(docs, id_col, text_col, width), "identities")
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups, _ = C.materialize(groups, "groups")
    return ids.join(groups, ["level", "name"], "left").select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("keep").isNull(), F.col("doc")).otherwise(F.col("keep.doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
