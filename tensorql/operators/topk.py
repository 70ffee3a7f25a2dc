"""The n largest values of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, n: int, rank: int = 2) -> DataFrame:
    """Of each row of the last dimension: d0, .., place (0 for the largest), index, val. Ties go to the smaller index."""
    *row, last = [f"d{k}" for k in range(rank)]
    order = Window.partitionBy(*row).orderBy(F.desc("val"), last)
    placed = df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)  # as such, so that tasks keep n rows each before the shuffle
    return placed.select(*row, (F.col("nth") - 1).alias("place"), F.col(last).alias("index"), "val")
