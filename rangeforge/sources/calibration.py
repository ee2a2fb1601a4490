"""Calibration: line nodes of each fan, from JSON or generated from a fan's asymptote and slope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "fan string, vertical boolean, direction int, i int, d double, x0 double, m double"


@dataclass(frozen=True)
class FanSpec:
    """A fan whose line at distance d crosses the middle row or column at asymptote + k / d, with slope slope + s / d."""

    name: str
    vertical: bool
    asymptote: float
    k: float
    slope: float
    s: float


FANS = (FanSpec("L", True, 600.0, -420.0, 0.03, 0.02), FanSpec("R", True, 640.0, 430.0, -0.03, -0.02), FanSpec("B", False, 230.0, 480.0, 0.01, 0.02))
#: Distances of the nodes: 28 from 2 m on, 0.4 m apart.
FIRST, STEP, COUNT = 2.0, 0.4, 28


def make_nodes(spark: SparkSession, fans=FANS, first: float = FIRST, step: float = STEP, count: int = COUNT) -> DataFrame:
    """Node table of fans that follow their formula, for tests and queries."""
    rows = F.array(*[F.struct(F.lit(f.name).alias("fan"), F.lit(f.vertical).alias("vertical"), F.lit(f.asymptote).alias("a"), F.lit(f.k).alias("k"), F.lit(f.slope).alias("sl"), F.lit(f.s).alias("s")) for f in fans])
    d = F.lit(first) + F.col("i") * F.lit(step)
    return spark.range(count).select(F.col("id").cast("int").alias("i"), F.explode(rows).alias("f")).withColumn("d", d).select(
        F.col("f.fan").alias("fan"), F.col("f.vertical").alias("vertical"), F.lit(1).alias("direction"), "i", "d", (F.col("f.a") + F.col("f.k") / F.col("d")).alias("x0"), (F.col("f.sl") + F.col("f.s") / F.col("d")).alias("m")
    )


NODES = """nodes AS (SELECT fan, vertical, i, d, a + k / d AS x0, sl + s / d AS m FROM (SELECT fan, vertical, a, k, sl, s, i::INT AS i, 2.0::DOUBLE + i * 0.4::DOUBLE AS d
FROM (VALUES ('L', true, 600.0::DOUBLE, -420.0::DOUBLE, 0.03::DOUBLE, 0.02::DOUBLE), ('R', true, 640.0, 430.0, -0.03, -0.02), ('B', false, 230.0, 480.0, 0.01, 0.02)) t(fan, vertical, a, k, sl, s), range(0, 28) r(i)))"""


def with_intervals(nodes: DataFrame) -> DataFrame:
    """nodes with the next node's distance and line, for bracketing."""
    by = Window.partitionBy("fan").orderBy("d")
    return nodes.withColumns({"d1": F.lead("d").over(by), "x1": F.lead("x0").over(by), "m1": F.lead("m").over(by)})


MAP = T.StructType([T.StructField("vertical", T.BooleanType()), T.StructField("direction", T.IntegerType()), T.StructField("d", T.ArrayType(T.DoubleType())), T.StructField("x0", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.DoubleType()))])
FILE = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("maps", T.MapType(T.StringType(), MAP)), T.StructField("camera", T.MapType(T.StringType(), T.DoubleType()))])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a calibration file; no maps give no rows, a missing direction is +1."""
    maps = spark.read.json(path, schema=FILE, multiLine=True).select(F.explode(F.coalesce("maps", F.create_map().cast(FILE["maps"].dataType))).alias("fan", "m"))
    zipped = maps.select("fan", F.col("m.vertical").alias("vertical"), F.coalesce("m.direction", F.lit(1)).alias("direction"), F.posexplode(F.arrays_zip("m.d", "m.x0", "m.m")).alias("i", "z"))
    return zipped.select("fan", "vertical", "direction", "i", F.col("z.d").alias("d"), F.col("z.x0").alias("x0"), F.col("z.m").alias("m"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """One JSON record with the maps of all fans; the node count is bounded by fans and calibration distances."""
    arrays = nodes.groupBy("fan").agg(F.first("vertical").alias("vertical"), F.first("direction").alias("direction"), F.sort_array(F.collect_list(F.struct("d", "x0", "m"))).alias("s"))
    maps = arrays.agg(F.map_from_entries(F.collect_list(F.struct("fan", F.struct("vertical", "direction", F.col("s.d").alias("d"), F.col("s.x0").alias("x0"), F.col("s.m").alias("m"))))).alias("maps"))
    maps.select(F.lit(1).alias("version"), "maps").coalesce(1).write.mode("overwrite").json(path)


def write_centre(centre: DataFrame, path: str) -> None:
    """One JSON record (cx, cy)."""
    centre.select("cx", "cy").coalesce(1).write.mode("overwrite").json(path)


def centre_of(computed: DataFrame, path: str | None) -> DataFrame:
    """(cx, cy, source): the centre in a file, where there is one, wins over the computed one."""
    spark = computed.sparkSession
    found = spark.createDataFrame([], "cx double, cy double")
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            found = spark.read.json(path, schema="cx double, cy double")
    both = found.select("cx", "cy", F.lit(0).alias("k"), F.lit("file").alias("source")).unionByName(computed.select("cx", "cy", F.lit(1).alias("k"), F.lit("computed").alias("source")))
    return both.where("cx IS NOT NULL AND cy IS NOT NULL").orderBy("k").limit(1).select("cx", "cy", "source")
