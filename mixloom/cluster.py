"""Cluster facilities: the shared folder, stored frames, broadcasts behind a size check."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold this many narrow rows (about 100 bytes each).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach: the session's checkpoint dir, or what `spark.checkpoint.dir` names.

    Where neither is set, only a local master gets a folder of its own, below the warehouse; on a cluster that is an
    error, since no other folder is known to be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Compute `df` once into the shared folder, where a lost executor cannot take it away."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of `df` only when it is known to be small.

    `rows` is a bound the caller can prove; without it the rows of `df` are counted (up to the
    limit), so `df` must then be cheap to read, e.g. a stored one. Above the limit no hint is
    given and adaptive execution shuffles, splitting hot keys.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan with few splits over `partitions` (the cores by default), in front of Python work.

    A caller whose input has enough splits leaves this out: it shuffles whole rows.
    """
    return df.repartition(partitions or df.sparkSession.sparkContext.defaultParallelism)
