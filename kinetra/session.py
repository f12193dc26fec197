"""The session's shared folder, and cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set for checkpoints; a new local one where neither is set, in local mode only."""
    sc = spark.sparkContext
    path, has = spark.conf.get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if not path and has.isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="kinetra-")
    if has.isEmpty():
        sc.setCheckpointDir(path)
    return (path or has.get()).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/kinetra-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
