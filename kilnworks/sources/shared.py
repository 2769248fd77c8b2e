"""The folder that driver and executors share, for what must outlast an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and Spark runs in one process (tests), one of our own."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        said = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "kilnworks")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, its lineage cut: written to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
