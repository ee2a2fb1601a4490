"""A folder that the driver and all executors see, for files that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; under the machine's own temporary folder only where all of Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = os.path.join(tempfile.gettempdir(), "rangeforge-scratch")
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def plain(path: str) -> str:
    """The path for open(). Formats that only plain files can hold need a mounted folder."""
    out = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in out:
        raise ValueError(f"{path} is not mounted as a plain folder")
    return out


def mounted(folder: str) -> str:
    """The folder as a path for open(); made if absent."""
    path = plain(folder)
    os.makedirs(path, exist_ok=True)
    return path
