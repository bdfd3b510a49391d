"""Cutting the lineage of iterative operators, so that plans don't grow with the rounds and lost executors cost one round."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table, of a few short columns, that may be broadcast.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a session in local mode may lack it: one machine runs
    everything there, so a temporary folder is shared too.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="spanlake-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, cut, and broadcast to what it is joined with if it has at most ``rows`` rows; else Spark chooses."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what was ``cut`` and is held no more, which it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
