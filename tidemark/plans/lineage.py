"""Cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a folder of its own; on a cluster it is an error, since executors share no other folder."""
    sc = spark.sparkContext
    live = sc._jsc.sc().getCheckpointDir()
    if live.isDefined():
        return live.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
