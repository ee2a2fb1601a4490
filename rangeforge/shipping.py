"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="rangeforge-"), "rangeforge_modules.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("rangeforge", os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Before Python stages over messages: bounds Arrow batches by bytes, as a message may be large. A row over the bound comes alone. The option stays set in the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
