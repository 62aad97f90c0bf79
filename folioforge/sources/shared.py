"""Results written to the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share.

    Only a session on one machine (local[...]), as in tests, may leave it unset; its checkpoints then go to a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that lost executors don't cost its history and what builds on it doesn't compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
