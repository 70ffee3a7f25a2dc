"""Tensors from tables and files, and back to files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorql.operators.lowering import grid, keys
from tensorql.sources.store import materialize


def densify(df: DataFrame, shape: tuple[int, ...], fill: float = 0.0) -> DataFrame:
    """Every position of the shape; where df has none, the fill. max, min, products and exponentials need this."""
    ks = keys(len(shape))
    return grid(df.sparkSession, shape).join(df.select(*ks, "val"), ks, "left").select(*ks, F.coalesce("val", F.lit(fill)).alias("val"))


def unique(df: DataFrame, rank: int, agg=F.sum) -> DataFrame:
    """One row for each position, by an aggregate of choice."""
    return df.groupBy(*keys(rank)).agg(agg("val").alias("val"))


def vectors(df: DataFrame, row: str, array: str) -> DataFrame:
    """A matrix from a column of arrays."""
    return df.select(F.col(row).cast("int").alias("d0"), F.posexplode(array).alias("d1", "v")).select("d0", "d1", F.col("v").cast("double").alias("val"))


def column(df: DataFrame, row: str, value: str) -> DataFrame:
    return df.select(F.col(row).cast("int").alias("d0"), F.col(value).cast("double").alias("val"))


def one_hot(df: DataFrame, row: str, label: str, classes: int) -> DataFrame:
    """1.0 at the label of each row, else 0.0."""
    each = df.select(F.col(row).cast("int").alias("d0"), F.col(label).alias("label"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("d1"))
    return each.select("d0", "d1", F.when(F.col("d1") == F.col("label"), 1.0).otherwise(0.0).alias("val"))


def gather(table: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Rows of a matrix (d0, d1, val) by ids (d0 position, id); an id below 0 or unknown gives a row of zeros."""
    wanted, rows = ids.select("d0", F.col("id").alias("row")), table.select(F.col("d0").alias("row"), "d1", "val")
    known = wanted.join(rows, "row").select("d0", "d1", F.coalesce("val", F.lit(0.0)).alias("val"))
    unknown = wanted.join(rows.select("row").distinct(), "row", "left_anti")
    zeros = unknown.select("d0", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("d1"), F.lit(0.0).alias("val"))
    return known.unionByName(zeros)


def iota(spark: SparkSession, shape: tuple[int, ...], start: float = 0.0) -> DataFrame:
    place = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        place = place * n + F.col(f"d{k}")
    return grid(spark, shape).withColumn("val", place.cast("double") + start)


def _uniform(seed: int, *salt) -> Column:
    """In (0, 1), a function of the position and the seed alone: the same whatever the partitioning, and when recomputed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *salt), 11).cast("double") + 0.5) / float(1 << 53)


def uniform(spark: SparkSession, shape: tuple[int, ...], seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return grid(spark, shape).withColumn("val", F.lit(low) + (high - low) * _uniform(seed, *keys(len(shape))))


def normal(spark: SparkSession, shape: tuple[int, ...], seed: int, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    u, v = _uniform(seed, *keys(len(shape)), F.lit(1)), _uniform(seed, *keys(len(shape)), F.lit(2))
    return grid(spark, shape).withColumn("val", F.lit(mean) + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * np.pi * v))


# Files.


def read_weights(spark: SparkSession, path: str, name_bytes: int = 50) -> DataFrame:
    """Files of records: name padded to 50 bytes, count (int64), that many f16. Rows (file, name, index, val)."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                while at + name_bytes + 8 <= len(data):
                    name = data[at : at + name_bytes].split(b"\0")[0].decode().strip()
                    (n,) = struct.unpack_from("<q", data, at + name_bytes)
                    at += name_bytes + 8
                    values = np.frombuffer(data, "<f2", n, at).astype(np.float32)
                    at += 2 * n
                    for k in range(0, n, 1 << 16):
                        part = values[k : k + (1 << 16)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(part)], ["file", "name", "index", "val"]
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, name string, index long, val float")


def weights_bytes(tensors: dict[str, np.ndarray], name_bytes: int = 50) -> bytes:
    out = b""
    for name, a in tensors.items():
        out += name.encode().ljust(name_bytes) + struct.pack("<q", a.size) + a.astype("<f2").tobytes()
    return out


def flat_to_tensor(df: DataFrame, shape: tuple[int, ...], *more: Column) -> DataFrame:
    """(index, val) in row-major order to positions."""
    rest, cols = int(np.prod(shape)), []
    for k, n in enumerate(shape):
        rest //= n
        cols.append(F.expr(f"cast(index div {rest} % {n} as int)").alias(f"d{k}"))
    return df.select(*cols, "val", *more)


def read_sharded(spark: SparkSession, path: str, name: str, shape: tuple[int, ...], along: int | None = None) -> DataFrame:
    """A tensor of files written by several writers, each with a strip of it along one dimension, in the order of the files' names; with along None the first file has it whole."""
    rows = read_weights(spark, path).where(F.col("name") == name)
    files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # as many as there were writers
    if along is None:
        return flat_to_tensor(rows.where(F.col("file") == files[0]), shape)
    strip = tuple(n // len(files) if k == along else n for k, n in enumerate(shape))
    if strip[along] * len(files) != shape[along]:
        raise ValueError(f"{len(files)} files don't share {shape[along]} evenly")
    which = F.array_position(F.array(*map(F.lit, files)), F.col("file")) - 1
    placed = flat_to_tensor(rows, strip, which.cast("int").alias("strip"))
    return placed.select(*((F.col(f"d{k}") + F.col("strip") * strip[k] if k == along else F.col(f"d{k}")).alias(f"d{k}") for k in range(len(shape))), "val")


def encode_texts(df: DataFrame, row: str, text: str, make: Callable[[], Callable[[str], list[int]]]) -> DataFrame:
    """(row, ids) by an external tokenizer. make() gives a worker its encoder, once for each task; null text has no ids."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            ids = [encode(t) if t is not None else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    kind = df.schema[row].dataType.simpleString()
    return df.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(run, f"row {kind}, ids array<int>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Files of texts, each after its length (int32). Rows (file, record, text)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, texts = 0, []
                while at + 4 <= len(data):
                    (n,) = struct.unpack_from("<i", data, at)
                    texts.append(data[at + 4 : at + 4 + n].decode("utf-8", "replace"))
                    at += 4 + n
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["file", "record", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, record long, text string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one text file, read in splits: lines are counted by split, and a split's lines numbered after those before it."""
    read = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    lines, _ = materialize(read, "lines")  # numbers are those of one reading
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of the file
    starts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("split").orderBy("at"))
    return lines.withColumn("nth", within).join(starts, "split").select((F.col("start") + F.col("nth") - 1).alias("line"), "text")


def read_multi_label(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A file with a first line "rows features labels", then lines "l,l f:v f:v". (labels (row, label), features (d0, d1, val)).

    Rows are numbered by their order in the file.
    """
    lines = numbered_lines(spark, path).where("line > 0 and trim(text) <> ''").select((F.col("line") - 1).alias("row"), "text")
    labels = lines.select("row", F.explode(F.split(F.split("text", " ")[0], ",")).alias("label")).where("label <> '' and label not like '%:%'")
    pairs = lines.select("row", F.explode(F.split("text", " ")).alias("p")).where("p like '%:%'")
    features = pairs.select(F.col("row").cast("int").alias("d0"), F.split("p", ":")[0].cast("int").alias("d1"), F.split("p", ":")[1].cast("double").alias("val"))
    return labels.select(F.col("row").cast("int").alias("row"), F.col("label").cast("int").alias("label")), features


def read_counts(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Of a counts file "c,c,..", by label: label, n, p and logit, as label_weights() gives them."""
    found = spark.read.text(path).where("trim(value) <> ''").select(F.posexplode(F.split("value", ",")).alias("label", "n"))
    p = F.col("n") / rows
    return found.select("label", F.trim("n").cast("long").alias("n")).select("label", "n", p.alias("p"), F.log(p / (1 - p)).alias("logit"))


def label_weights(labels: DataFrame, rows: int) -> DataFrame:
    """Of each label: count, share p, and the logit of p."""
    p = F.col("n") / rows
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", p.alias("p"), F.log(p / (1 - p)).alias("logit"))


def parse_nested(df: DataFrame, text: str, depth: int) -> DataFrame:
    """Positions and values of nested-bracket arrays: [[1,2],[3,4]]."""
    out = df.select(F.from_json(text, "array<" * depth + "double" + ">" * depth).alias("x"))
    names = keys(depth)
    for k in names:
        out = out.select(*(c for c in out.columns if c != "x"), F.posexplode("x").alias(k, "x"))
    return out.select(*names, F.col("x").alias("val"))


def next_token_windows(tokens: DataFrame, size: int, seed: int, pad: int = -1) -> DataFrame:
    """tokens: (doc_id, ids). A window of size ids and the id after it, from a place drawn by seed and doc_id; short documents are padded at the left.

    Documents without ids give no row.
    """
    n = F.size("ids")
    start = F.when(n > size, (_uniform(seed, F.col("doc_id")) * (n - size)).cast("int")).otherwise(0)
    at = tokens.where("size(ids) > 0").withColumn("start", start)
    inside = F.when(n > size, F.slice("ids", F.col("start") + 1, F.lit(size))).otherwise(F.slice("ids", F.lit(1), n - 1))
    at = at.withColumn("inside", inside).withColumn("target", F.when(n > size, F.element_at("ids", F.col("start") + size + 1)).otherwise(F.element_at("ids", -1)))
    padded = F.concat(F.array_repeat(F.lit(pad).cast("int"), F.lit(size) - F.size("inside")), F.col("inside").cast("array<int>"))
    return at.select("doc_id", padded.alias("window"), "target")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
