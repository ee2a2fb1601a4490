"""Functions for SQL: poisson_critical(mean, alpha), polar_range, bearing_about, and the table function decode_pointcloud2(data)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.fits import poisson_critical
from ..shipping import ship_package
from ..sources.pointcloud2 import columns_of, read_layout


class DecodePointCloud2:
    """One row for each point of a message; none for a null message."""

    def eval(self, data: bytes):
        if data is None:
            return
        layout = read_layout(bytes(data))
        got = columns_of(bytes(data), layout, ("x", "y", "z", "intensity", "ring"))
        for i in range(layout.count):
            yield (i, *(None if got[c] is None else got[c][i].item() for c in ("x", "y", "z", "intensity", "ring")))


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL. The table function is for looking at messages; decode_frames reads whole recordings in Arrow batches."""
    ship_package(spark)
    critical = F.pandas_udf(lambda mean, alpha: pd.Series([poisson_critical(float(m), float(a)) for m, a in zip(mean, alpha, strict=True)]), "int")
    spark.udf.register("poisson_critical", critical)
    spark.udtf.register("decode_pointcloud2", F.udtf(DecodePointCloud2, returnType="pt_idx int, x float, y float, z float, intensity float, ring int"))
    for sql in (
        "CREATE OR REPLACE TEMPORARY FUNCTION polar_range(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN hypot(x, y)",
        "CREATE OR REPLACE TEMPORARY FUNCTION bearing_about(x DOUBLE, y DOUBLE, cx DOUBLE, cy DOUBLE) RETURNS DOUBLE RETURN pmod(degrees(atan2(y - cy, x - cx)), 360D)",
    ):
        spark.sql(sql)
