"""Filters, samples, unions and set operations on recordings and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_cloud(x_max: float = 100.0, y_max: float = 250.0, z_max: float = 50.0) -> Column:
    """Finite, not the origin, and within the sensor's reach."""
    zero = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return finite("x") & finite("y") & finite("z") & ~zero & (F.abs("x") < x_max) & (F.abs("y") < y_max) & (F.abs("z") < z_max)


def away_from_sensor(least: float = 0.3) -> Column:
    return finite("x") & finite("y") & finite("z") & (F.hypot("x", "y") > least)


def returned(with_attribute: bool = True) -> Column:
    """Not an empty return (all zero), place finite; the attribute itself may be missing."""
    zero = (F.col("x") == 0) & (F.col("y") == 0)
    if with_attribute:
        zero = zero & (F.coalesce(F.col("s"), F.lit(-1)) == 0)
    return finite("x") & finite("y") & ~zero


def frames_mostly(points: DataFrame, keys: list[str], good: Column, share: float = 0.9) -> DataFrame:
    """Rows of the frames at least `share` of whose points are good."""
    ok = points.groupBy(*keys).agg(F.avg(good.cast("int")).alias("_s")).where(F.col("_s") >= share).select(*keys)
    return points.join(ok, keys, "left_semi")


def in_rectangle(points: DataFrame, centre: DataFrame, keys: list[str], width: float, z_lo: float, z_hi: float) -> DataFrame:
    """Points within half the width of their frame's centre xc and between two heights."""
    return points.join(centre, keys).where((F.abs(F.col("lat") - F.col("xc")) <= width / 2) & (F.col("ver") >= z_lo) & (F.col("ver") <= z_hi))


def crosses_box(p: list[Column], lo: tuple, hi: tuple) -> Column:
    """Whether the segment from the origin to p, short of p itself, meets an axis-parallel box (slab test)."""
    enter, leave = [], []
    for c, a, b in zip(p, lo, hi, strict=True):
        inside = F.lit(a <= 0 <= b)
        enter.append(F.when(c == 0, F.when(inside, -1e30).otherwise(1e30)).otherwise(F.least(F.lit(float(a)) / c, F.lit(float(b)) / c)))
        leave.append(F.when(c == 0, F.when(inside, 1e30).otherwise(-1e30)).otherwise(F.greatest(F.lit(float(a)) / c, F.lit(float(b)) / c)))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    return (t0 <= t1) & (t1 >= 0) & (t0 <= 0.999999)


def every(rows: DataFrame, index: str, step: int) -> DataFrame:
    return rows.where(F.pmod(F.col(index), F.lit(step)) == 0)


def stride_sample(rows: DataFrame, keys: list[str], index: str, target: int) -> DataFrame:
    """Every floor(n / target)-th row of each key."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return rows.join(counts, keys).where(F.pmod(F.col(index), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / target))) == 0).drop("_n")


def seeded_cap(rows: DataFrame, keys: list[str], index: str, cap: int, seed: int) -> DataFrame:
    """At most `cap` rows of each key, chosen by the MD5 of the index and the seed, `index:seed` as text."""
    spot = F.md5(F.concat_ws(":", F.col(index).cast("string"), F.lit(str(seed))))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(spot, index))).where(F.col("_k") <= cap).drop("_k")


def union_cells(*masks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    out = masks[0].select(*(keys or []), "iu", "iv")
    for m in masks[1:]:
        out = out.unionByName(m.select(out.columns))
    return out.distinct()


def cell_difference(now: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of `now` that the reference has not."""
    return now.select(*keys, "iu", "iv").join(reference.select(*keys, "iu", "iv"), [*keys, "iu", "iv"], "left_anti")


def box_sum(cells: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    """Sum over the square around each cell, for every cell it reaches."""
    side = range(-radius, radius + 1)
    moved = F.explode(F.array(*[F.struct((F.col("iu") + a).alias("iu"), (F.col("iv") + b).alias("iv")) for a in side for b in side]))
    return cells.select(*keys, moved.alias("c"), value).groupBy(*keys, "c.iu", "c.iv").agg(F.sum(value).alias(value))


def topics(frames: DataFrame) -> DataFrame:
    return frames.groupBy("topic").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first_seen"))


def chosen_topics(topics: DataFrame) -> DataFrame:
    """One row: the most frequent topic (ties to the one seen first), and the first one seen."""
    return topics.agg(F.max_by("topic", F.struct("n", -F.col("first_seen"))).alias("most_frequent"), F.min_by("topic", "first_seen").alias("first_topic"))


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Rows of all runs; columns that a run lacks are null."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
