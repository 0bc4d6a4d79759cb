"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one, in local mode alone."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.replace("file:/", "file:///", 1) if set_to.startswith("file:/") and not set_to.startswith("file://") else set_to


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the checkpoint folder, so that losing an executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
