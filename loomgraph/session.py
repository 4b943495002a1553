"""Intermediate results that survive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and Spark runs in one process
    (local tests), a new temporary folder, which is then also set as the checkpoint folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer pieces than there are: a table of one small file has one. Large tables stay
    as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; a lost executor then loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
