"""Loops whose state is tensors: training and decoding. Each round is one batch of jobs.

The state is cut from its lineage every round, by a table or a checkpoint in the shared folder
that the session names in spark.checkpoint.dir, so plans don't grow and lost executors only
cost the round that runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tensorql.sources.store import shared_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's own folder; see store.shared_dir()."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def iterate(spark: SparkSession, state: dict[str, DataFrame], step: Callable[[dict[str, DataFrame], int], dict[str, DataFrame]], rounds: int) -> dict[str, DataFrame]:
    """step(state, round) gives the next state; every table of it is checkpointed."""
    ensure_checkpoint_dir(spark)
    for k in range(rounds):
        state = {name: df.checkpoint() for name, df in step(state, k).items()}
    return state
