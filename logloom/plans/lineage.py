"""Cutting long lineages through reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is set."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = shared or tempfile.mkdtemp(prefix="logloom-checkpoint-")  # one machine, so its folder is shared
    sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Same rows, new lineage: later plans start from the checkpoint files, which
    survive lost executors and spare the optimizer the plan that made them."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
