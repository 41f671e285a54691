"""Folders that driver and executors share, for sinks and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode a folder of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again."""
    path = scratch_path(df.sparkSession, "t")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def driver_path(name: str) -> str:
    """A new folder of the driver's own."""
    return tempfile.mkdtemp(prefix=f"spark-{name}-")
