"""Robust and weighted aggregates: percentiles, thresholds, means, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_percentiles


def axis_spread(points: DataFrame, columns: list[str]) -> DataFrame:
    """(axis, place, span, median, centre): 1st to 99th percentile span of each coordinate, and the middle of that span."""
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.lit(k).alias("place"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])).alias("a")).select("a.*")
    low, middle, high = (F.col("q")[k] for k in range(3))
    return exact_percentiles(long, ["axis", "place"], "x", [0.01, 0.5, 0.99]).select("axis", "place", (high - low).alias("span"), middle.alias("median"), ((high + low) / 2).alias("centre"))


def detect_axes(points: DataFrame, columns: list[str]) -> DataFrame:
    """One row (forward, sign, lateral, vertical): the widest axis is forward and looks the way its median lies.
    Of the other two the wider is lateral; if their spans are within 20 % of the wider one, it is the one centred nearer to zero, the later one if equal."""
    spread = F.array_sort(F.collect_list(F.struct((-F.col("span")).alias("k"), "place", "axis", "median", "span", F.abs("centre").alias("off"))))
    s = axis_spread(points, columns).agg(spread.alias("s"))
    a, b, c = (F.get("s", F.lit(i)) for i in range(3))
    close = b["span"] - c["span"] <= 0.2 * b["span"]
    swap = close & F.when(c["place"] < b["place"], c["off"] < b["off"]).otherwise(c["off"] <= b["off"])
    return s.select(a["axis"].alias("forward"), F.when(a["median"] < 0, -1).otherwise(1).alias("sign"), F.when(swap, c["axis"]).otherwise(b["axis"]).alias("lateral"), F.when(swap, b["axis"]).otherwise(c["axis"]).alias("vertical"))


def order_statistic_threshold(rows: DataFrame, keys: list[str], level: str, low: float = 0.30, high: float = 0.80, floor: float = 25.0) -> DataFrame:
    """(keys, threshold): mean of the order statistics at floor(low n) and floor(high n) of an integer level, at least `floor`.

    Counts by level and a running sum over levels: levels are few (256 for
    images), so nothing is sorted row by row.
    """
    counts = rows.groupBy(*keys, level).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    up_to = F.sum("n").over(by.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    runs = counts.withColumns({"up": up_to, "total": F.sum("n").over(by)})
    at = lambda p: F.min(F.when(F.col("up") > F.floor(F.col("total") * p), F.col(level)))
    return runs.groupBy(*keys).agg(F.greatest(F.lit(floor), 0.5 * (at(low) + at(high))).alias("threshold"))


def bright_threshold(pixels: DataFrame, keys: list[str], x: str, y: str, gray: str, stride: int = 4) -> DataFrame:
    """(keys, threshold): max(200, 99th percentile - 25) over every stride-th row and column."""
    return pixels.where((F.col(x) % stride == 0) & (F.col(y) % stride == 0)).groupBy(*keys).agg(F.greatest(F.lit(200.0), F.percentile(gray, 0.99) - 25).alias("threshold"))


def weighted_peak(rows: DataFrame, keys: list[str], d: str, score: str, least: float, band: float = 0.5, share: float = 0.4) -> DataFrame:
    """(keys, peak_d, d): score-weighted mean of d around the row of highest score, over rows within `band` with at least `share` of it.
    Keys whose highest score is under `least` have none. Equal scores: the smallest d."""
    best = rows.groupBy(*keys).agg(F.max(score).alias("peak"), F.min_by(d, F.struct((-F.col(score)).alias("s"), d)).alias("peak_d")).where(F.col("peak") >= least)
    near = rows.join(best, keys).where((F.abs(F.col(d) - F.col("peak_d")) <= band) & (F.col(score) >= share * F.col("peak")))
    return near.groupBy(*keys, "peak_d").agg((F.sum(F.col(d) * F.col(score)) / F.sum(score)).alias("wall"))


def circular_mean(theta: Column, weight: Column) -> Column:
    """Weighted mean angle in degrees, 0 up to 360."""
    t = F.radians(theta)
    return F.pmod(F.degrees(F.atan2(F.sum(weight * F.sin(t)), F.sum(weight * F.cos(t)))), F.lit(360.0))


def nearest_k_median(rows: DataFrame, keys: list[str], d: str, tie: str, k: int = 20) -> DataFrame:
    """(keys, d_median, used): median of the k smallest d."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(d, tie))
    return rows.withColumn("_k", rank).where(F.col("_k") <= k).groupBy(*keys).agg(F.percentile(d, 0.5).alias("d_median"), F.count("*").alias("used"))


def closest_rule(readings: DataFrame, keys: list[str], fan: str, d: str, ratio: float = 0.75) -> DataFrame:
    """(keys, fans, closest): least reading of each fan; of two or more the least one if it is at most `ratio` of their upper middle one, else the median of all."""
    per_fan = readings.groupBy(*keys, fan).agg(F.min(d).alias("d"))
    s = per_fan.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("s"))
    upper = F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))
    lower = F.element_at("s", (F.floor((F.size("s") + 1) / 2)).cast("int"))
    least = F.element_at("s", 1)
    return s.select(*keys, F.size("s").alias("fans"), F.when((F.size("s") >= 2) & (least / upper <= ratio), least).otherwise((lower + upper) / 2).alias("closest"))


def error_report(pairs: DataFrame, keys: list[str], measured: str, true: str) -> DataFrame:
    e = F.col(measured) - F.col(true)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rms"), F.max(F.abs(e)).alias("max_abs"), F.avg(e).alias("bias"))


def channel_percentiles(rows: DataFrame, channel: str, value: str, at: list[float]) -> DataFrame:
    """(channel, n, p...): rows of each channel and exact percentiles of their values, null where it has none."""
    found = exact_percentiles(rows, [channel], value, at).select(F.col(channel).alias("_channel"), "q")
    counts = rows.groupBy(channel).agg(F.count("*").alias("n"))
    return counts.join(found, F.col(channel).eqNullSafe(F.col("_channel")), "left").select(channel, "n", *[F.get("q", F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(at)])


def value_frequencies(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def frame_stats(frames: DataFrame, keys: list[str], d: str, ts_seconds: Column) -> DataFrame:
    """Counts, range percentiles, duration and frame rate (within 1 to 30) of each recording."""
    took = F.max(ts_seconds) - F.min(ts_seconds)
    rate = F.when(took > 0, F.least(F.lit(30.0), F.greatest(F.lit(1.0), (F.count("*") - 1) / took))).otherwise(1.0)
    return frames.groupBy(*keys).agg(F.count("*").alias("n"), F.min(d).alias("d_min"), F.max(d).alias("d_max"), F.percentile(d, 0.5).alias("d_median"), F.percentile(d, 0.98).alias("d_p98"), took.alias("seconds"), rate.alias("fps"))


def corridor_share(rows: DataFrame, keys: list[str], s: str, low: float = 14.0, high: float = 60.0) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg((F.col(s) < low).cast("double")).alias("low_share"), F.avg((F.col(s) >= high).cast("double")).alias("high_share"))


def sequence_summary(counts: DataFrame, keys: list[str], frame: str, columns: list[str]) -> DataFrame:
    """Least, greatest and mean of counts over frames, and the first frame of the greatest."""
    parts = []
    for c in columns:
        parts += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"), F.max_by(frame, F.struct(c, -F.col(frame))).alias(f"{c}_argmax")]
    return counts.groupBy(*keys).agg(F.count("*").alias("frames"), *parts)


def clipped_running(rows: DataFrame, key: str, frame: str, outside: Column) -> DataFrame:
    """(key, frame, clipped, worst): points off the canvas in each frame and the most so far."""
    per = rows.groupBy(key, frame).agg(F.sum(outside.cast("long")).alias("clipped"))
    return per.withColumn("worst", F.max("clipped").over(Window.partitionBy(key).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)))


def max_grid(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Greatest value in each (row, column), one column for each of `columns`."""
    return rows.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, F.col(value))).alias(f"c{c}") for c in columns])


def scenario_digest(objects: DataFrame, scenario: str, kind: Column, size: str, name: str, top: int = 5) -> DataFrame:
    """(scenario, objects, stable, largest): counts and the names of the largest objects in order."""
    rank = F.row_number().over(Window.partitionBy(scenario).orderBy(F.desc(size), name))
    ranked = objects.withColumns({"_stable": kind, "_k": rank})
    largest = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_k") <= top, F.struct("_k", F.col(name).alias("n"))))), lambda x: x["n"].cast("string")), ",")
    return ranked.groupBy(scenario).agg(F.count("*").alias("objects"), F.sum(F.col("_stable").cast("long")).alias("stable"), largest.alias("largest"))


def row_median_norm(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value over its row's median, zero cells included; a median of zero counts as one."""
    m = cells.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_m"))
    return cells.join(m, keys).withColumn("strength", F.col(value) / F.when(F.col("_m") == 0, 1.0).otherwise(F.col("_m"))).drop("_m")
