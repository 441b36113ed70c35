"""A folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one. Unset, it is a temporary folder in plain local mode (tests) and an error
    on anything else: executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="threadloom-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        return "file://" + _local["dir"]
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
