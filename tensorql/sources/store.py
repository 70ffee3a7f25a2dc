"""Tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one given to setCheckpointDir. Where neither is set, /tmp, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table written by materialize()."""
    with contextlib.suppress(Exception):
        fs, p = file_system(spark, path)
        fs.delete(p, True)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Spark deletes a query's shuffle files as it ends, instead of when the driver's collector comes round."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df once into the shared folder and reads it back: lineage ends here, and lost executors lose nothing.

    Returns the table and its path. It is deleted when the driver ends, or earlier by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path), path
