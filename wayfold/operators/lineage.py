"""Tables that are read more than once, cut from what made them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Reliable checkpoints need a folder that all executors share; only where all tasks run
    on one machine (tests) a temporary one takes its place."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder: a lost executor costs the tasks
    it ran, and later readers don't run what made the table again."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
