"""What the text operators share: tables in the shared folder, connected components, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorql.sources.store import discard, materialize, shared_dir  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context; executors fetch it from the driver."""
    sc = spark.sparkContext
    if not getattr(sc, "_tensorql_shipped", False):
        folder = tempfile.mkdtemp(prefix="tensorql-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/tensorql", "zip", ROOT, "tensorql"))
        sc._tensorql_shipped = True


def col(name: str) -> Column:
    """The top-level column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def sign(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of a small-typed table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns u, v (any orderable type) to (node, root): root is the least node of the component.

    Alternating large-star and small-star contraction: every round replaces links by links to
    the least neighbour, so the number of rounds is logarithmic in the diameter. Per-node work
    is a partial aggregation and a join that AQE can split, never a group in one task. Each
    round is written to the shared folder, and the round before it is deleted.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v and u is not null and v is not null").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e, path = materialize(e.distinct(), "links")
    now = sign(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path = materialize(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links"
        )
        discard(spark, path)
        before, now, e, path = now, sign(after), after, after_path
        if before == now:
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
