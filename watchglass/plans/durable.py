"""Writing a shared intermediate result once, where every executor can read it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir, if the cluster names one.

    A local session without the setting gets a temporary folder; on a cluster
    that would be machine-local, so there the setting is required.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="watchglass-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute `df` now, once, for several readers; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
