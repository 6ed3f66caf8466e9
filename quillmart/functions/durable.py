"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; only a local master without it gets a temporary folder.

    On a cluster an unset folder is an error, because executors do not share the driver's disk. Unless the session says
    otherwise, Spark deletes a checkpoint when nothing refers to it any more.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmart-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read from the checkpoint folder, so that a lost executor costs no earlier stage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
