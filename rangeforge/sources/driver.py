"""The driver's tables seen as recordings: points, an ordered signal, profiles, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .calibration import make_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bag, frame_idx, f, lat, ver, intensity) from lineitem."""
    return points_of(table(spark, sf_dir, "lineitem"))


def points_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_suppkey") % 4).alias("bag"), (F.col("l_orderkey") % 40).alias("frame_idx"), F.col("l_quantity").alias("f"),
        (F.round(F.col("l_discount") * 100) - 5).alias("lat"), (F.round(F.col("l_tax") * 100) - 4).alias("ver"), F.col("l_extendedprice").alias("intensity"),
    )


POINTS = """points AS (SELECT l_suppkey % 4 AS bag, l_orderkey % 40 AS frame_idx, l_quantity AS f,
  round(l_discount * 100) - 5 AS lat, round(l_tax * 100) - 4 AS ver, l_extendedprice AS intensity FROM lineitem)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bag, frame_idx, event_id, ts, d, theta, fam) from events, frames numbered from 0 in time order within a bag."""
    order = Window.partitionBy("bag").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("bag"), "event_id", "ts", F.col("value").alias("d"), (F.col("event_id") * 37 % 360).alias("theta"), F.col("event_type").alias("fam"))
    return events.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))


SIGNAL = """signal AS (SELECT user_id % 8 AS bag, event_id, ts, value AS d, event_id * 37 % 360 AS theta, event_type AS fam,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame_idx FROM events)"""


def measured_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration nodes as events measured them: each event is a reading of one fan at one distance, off the fan's formula by its value; a node is their mean."""
    reading = table(spark, sf_dir, "events").select(
        F.element_at(F.array(*map(F.lit, "LRB")), (F.col("event_id") % 3 + 1).cast("int")).alias("fan"),
        (F.floor(F.col("event_id") / 3) % 28).cast("int").alias("i"), (F.floor("value").cast("long") % 11 - 5).alias("e"),
    )
    seen = reading.groupBy("fan", "i").agg(F.avg("e").alias("e"))
    return make_nodes(spark).join(seen, ["fan", "i"]).select("fan", "vertical", "direction", "i", "d", (F.col("x0") + F.col("e") / 100).alias("x0"), (F.col("m") + F.col("e") / 100000).alias("m"))


MEASURED = """nodes AS (SELECT fan, vertical, i, d, a + k / d + e / 100 AS x0, sl + s / d + e / 100000 AS m FROM (SELECT fan, vertical, a, k, sl, s, i, 2.0::DOUBLE + i * 0.4::DOUBLE AS d, e
FROM (VALUES (0, 'L', true, 600.0::DOUBLE, -420.0::DOUBLE, 0.03::DOUBLE, 0.02::DOUBLE), (1, 'R', true, 640.0, 430.0, -0.03, -0.02), (2, 'B', false, 230.0, 480.0, 0.01, 0.02)) t(f, fan, vertical, a, k, sl, s)
JOIN (SELECT event_id % 3 AS f, (event_id // 3 % 28)::INT AS i, avg(floor(value)::BIGINT % 11 - 5) AS e FROM events GROUP BY ALL) r USING (f)))"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bin, v) from embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("bin", "x")).select("vec_id", "label", "bin", F.col("x").cast("double").alias("v"))


PROFILES = """profiles AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS bin, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
