"""The folder that driver and executors share, and tables cut off from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df's rows and partitions as they are now, held in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
