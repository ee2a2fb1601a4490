"""How far each recording's way is free, frame by frame, with alarm levels.

Points within the corridor are counted in cells of depth and lateral place. The
way of a frame is free up to the depth at which `points_needed` points have been
met, or to `depth_limit`; single stray points don't stop it. Distances are
smoothed by a median over neighbouring frames and given a level.

    python -m jobs.clearance --input LINEITEM --output FOLDER [--config jobs/clearance.json]

FOLDER has a partition a recording. A rerun replaces the partitions of the
recordings that it reads by the same rows, and leaves those of others. Frames
without a point in the corridor are free to the limit; points with a null
coordinate are in no corridor. Rows without recording or frame are left out, and
their number is logged. Repeated rows are points of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import keep_empty, log, main, settings
from rangeforge.functions.scaling import level
from rangeforge.operators.grids import occupancy
from rangeforge.operators.windows import moving_median
from rangeforge.sources.driver import points_of

DEFAULTS = {"depth_step": 2.0, "lateral_step": 0.1, "depth_limit": 180.0, "half_width": 3.5, "points_needed": 3, "smooth_frames": 3, "alarm": 4.0, "warn": 8.0}
KEYS = ["bag", "frame_idx"]
CLEARANCE = "frame_idx long, points long, clearance double, smooth double, level string, bag long"


def clearance(points: DataFrame, use: dict) -> DataFrame:
    """(frame_idx, points, clearance, smooth, level, bag), one row a frame. Points are counted by cell before frames are put in order."""
    cells = occupancy(points, use["depth_step"], use["lateral_step"], use["depth_limit"], use["half_width"], KEYS)
    depths = cells.groupBy(*KEYS, "d_bin").agg(F.sum("n").alias("n"))
    met = depths.withColumn("met", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("d_bin").rowsBetween(Window.unboundedPreceding, 0)))
    stops = met.groupBy(*KEYS).agg(F.sum("n").alias("points"), F.min(F.when(F.col("met") >= use["points_needed"], F.col("d_bin"))).alias("stop"))
    frames = points.select(*KEYS).distinct().join(stops, KEYS, "left")
    free = F.coalesce(F.col("stop") * F.lit(use["depth_step"]), F.lit(use["depth_limit"]))
    rows = frames.select(*KEYS, F.coalesce("points", F.lit(0)).cast("long").alias("points"), free.alias("clearance"))
    smooth = moving_median(rows, ["bag"], "frame_idx", "clearance", half=use["smooth_frames"] // 2)
    return smooth.select("frame_idx", "points", "clearance", "smooth", level(F.col("smooth"), use["alarm"], use["warn"]).alias("level"), "bag")


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> str:
    """Writes the clearance of all recordings in `source` and returns the folder."""
    use = settings(DEFAULTS, config)
    keep_empty(spark.createDataFrame([], CLEARANCE), output)
    every = points_of(spark.read.parquet(source))
    clearance(every.where("bag IS NOT NULL AND frame_idx IS NOT NULL"), use).write.partitionBy("bag").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(output)
    seen = every.agg(F.count("*").alias("n"), F.count_if(F.expr("bag IS NULL OR frame_idx IS NULL")).alias("lost")).first()
    written = spark.read.schema(CLEARANCE).parquet(output).groupBy("level").count().collect()
    log.info("read %d points of %s, %d of them without recording or frame; %s holds frames by level: %s", seen.n, source, seen.lost, output, {r["level"]: r["count"] for r in written})
    return output


if __name__ == "__main__":
    main(run, "clearance", "How far each recording's way is free, with alarm levels.")
