"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder under a local master (tests), and an error on a cluster, whose machines
    share no such folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.TemporaryDirectory(prefix="signalwright-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        sc.setCheckpointDir(f"file://{own.name}")
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)
