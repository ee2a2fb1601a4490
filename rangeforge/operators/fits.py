"""Fits: inverse distance, total least squares, isotonic steps, map quality, Poisson counts, rails, tunnel bins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .ordered import added


def inverse_fit(rows: DataFrame, keys: list[str], d: str, y: str) -> DataFrame:
    """(keys, v0, k): least squares of y = v0 + k / d. A distance of 0 is an infinite 1 / d, so its key has no fit: v0 is null and k not a number."""
    x = F.when(F.col(d) == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), F.col(d)))
    fit = rows.groupBy(*keys).agg(F.regr_intercept(F.col(y), x).alias("v0"), F.regr_slope(F.col(y), x).alias("k"))
    return fit.withColumn("v0", F.when(~F.isnan("v0"), F.col("v0")))


def tls_line(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, a, b, c, rms): line a x + b y + c = 0 of least squared distance, (a, b) a unit vector with a > 0, or a = 0 and b > 0.

    The normal is the eigenvector of the smaller eigenvalue of the 2x2 covariance.
    """
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    angle = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))  # direction of the larger axis
    a, b = -F.sin(angle), F.cos(angle)
    sign = F.when((a < 0) | ((a == 0) & (b < 0)), -1.0).otherwise(1.0)
    small = 0.5 * (F.col("xx") + F.col("yy") - F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2))
    out = m.withColumns({"a": a * sign, "b": b * sign, "rms": F.sqrt(F.greatest(small, F.lit(0.0)))})
    return out.select(*keys, "n", "a", "b", (-(F.col("a") * F.col("mx") + F.col("b") * F.col("my"))).alias("c"), "rms")


def isotonic_values(y: np.ndarray) -> np.ndarray:
    """Non-decreasing values of least squared difference: neighbouring pools are merged while they fall."""
    means, sizes = [], []
    for v in y:
        mean, size = float(v), 1
        while means and means[-1] > mean:
            m, n = means.pop(), sizes.pop()
            mean, size = (mean * size + m * n) / (size + n), size + n
        means.append(mean)
        sizes.append(size)
    return np.repeat(means, sizes)


def isotonic(rows: DataFrame, keys: list[str], order: str, y: str, *, rising: bool = True) -> DataFrame:
    """rows with `fit`, monotone along `order` in each key. Many keys are fitted a batch."""
    def fit(v) -> list:
        v = v.to_numpy(float)
        return [isotonic_values(v) if rising else -isotonic_values(-v)]

    return added(rows, keys, [order], [y], fit, "fit double")


def local_quality(nodes: DataFrame, span: float = 1.5, slope_weight: float = 150.0) -> DataFrame:
    """(fan, i, quality): how far a fan's line moves around each node: steps, each the hypotenuse of shift and weighted slope, whose middle lies within +- span; 0 if none does."""
    by = Window.partitionBy("fan").orderBy("d")
    steps = nodes.withColumns({"_d1": F.lead("d").over(by), "_s": F.hypot(F.lead("x0").over(by) - F.col("x0"), slope_weight * (F.lead("m").over(by) - F.col("m")))})
    inside = steps.where("_d1 IS NOT NULL").select(F.col("fan").alias("_f"), ((F.col("d") + F.col("_d1")) / 2).alias("_mid"), "_s")
    return nodes.join(F.broadcast(inside) if inside.limit(10_001).count() <= 10_000 else inside, (F.col("fan") == F.col("_f")) & (F.abs(F.col("_mid") - F.col("d")) <= span), "left").groupBy("fan", "i").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("quality"))


def vanishing_centre(nodes: DataFrame, default: tuple[float, float] = (614.0, 225.0), size: tuple[float, float] = (1280.0, 720.0), margin: float = 200.0) -> DataFrame:
    """One row (cx, cy): mean of where the asymptotes of the side fans meet the bottom fan's. A crossing over `margin` pixels off the image doesn't count; the default if none does."""
    fits = nodes.groupBy("fan").agg(*[f(F.col(c), 1 / F.col("d")).alias(n) for c, n, f in (("x0", "x0", F.regr_intercept), ("m", "m", F.regr_intercept))])
    one = fits.agg(*[F.max(F.when(F.col("fan") == fan, F.col(c))).alias(f"{fan}_{c}") for fan in "LRB" for c in ("x0", "m")])
    # side: x = m (y - 360) + x0; bottom: y = M (x - 640) + Y0
    def meet(fan: str) -> tuple[Column, Column]:
        m, x0, big, y0 = F.col(f"{fan}_m"), F.col(f"{fan}_x0"), F.col("B_m"), F.col("B_x0")
        x = (m * (y0 - big * 640.0 - 360.0) + x0) / (1 - m * big)
        return x, big * (x - 640.0) + y0

    points = [F.when(x.between(-margin, size[0] + margin) & y.between(-margin, size[1] + margin), F.struct(x.alias("x"), y.alias("y"))) for x, y in (meet("L"), meet("R"))]
    met = one.select(F.array_compact(F.array(*points)).alias("p"))
    mean = lambda c, k: F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda s, q: s + q[c]) / F.size("p")).otherwise(default[k]).alias(f"c{c}")
    return met.select(mean("x", 0), mean("y", 1))


def extrapolated(y0: Column, v0: Column, k: Column, lo: float = 0.4, hi: float = 2.05) -> Column:
    """Distance below the map's range from y0 = v0 + k / d, if in reach."""
    d = F.try_divide(k, y0 - v0)
    return F.when((d >= lo) & (d <= hi), d)


def poisson_critical(mean: float, alpha: float = 0.01, most: int = 200) -> int:
    """Least count whose upper tail under a Poisson mean is at most alpha, at most `most`."""
    if mean <= 0:
        return 1
    tail = 1.0
    for k in range(most):
        if tail <= alpha:
            return k
        tail -= math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
    return most


def critical_counts(means: DataFrame, mean: str, alpha: float) -> DataFrame:
    """means with `critical`, evaluated in Arrow batches; there is no log-gamma among the built-in functions."""
    ship_package(means.sparkSession)

    @F.pandas_udf("int")
    def critical(m: pd.Series) -> pd.Series:
        return m.map(lambda x: poisson_critical(float(x), alpha))

    return means.withColumn("critical", critical(F.col(mean)))


def rail_offsets(points: DataFrame, keys: list[str], half: float, tolerance: float, offsets: list[float]) -> DataFrame:
    """(keys, offset, score): best rail template: points near both rails, score 2 min + 0.2 sum; the first offset of equal scores."""
    many = points.withColumn("_o", F.explode(F.array(*map(F.lit, offsets))))
    near = lambda side: F.sum((F.abs(F.col("lat") - F.col("_o") - side * half) <= tolerance).cast("long"))
    scores = many.groupBy(*keys, "_o").agg(near(-1).alias("_l"), near(1).alias("_r")).withColumn("score", 2.0 * F.least("_l", "_r") + 0.2 * (F.col("_l") + F.col("_r")))
    return scores.groupBy(*keys).agg(F.min_by("_o", F.struct((-F.col("score")).alias("s"), "_o")).alias("offset"), F.max("score").alias("score"))


def tunnel_bins(points: DataFrame, keys: list[str], width: float, first: float, wall: float = 1.6, least: int = 20) -> DataFrame:
    """(keys, d_idx, x_left, x_right, z_floor, z_ceil): robust limits of each distance bin with enough points; null where out of bounds."""
    at = points.where(F.col("f") >= first).withColumn("d_idx", F.floor((F.col("f") - first) / width))
    side = lambda c, p, keep: F.when(F.sum(keep.cast("int")) > 5, F.percentile(F.when(keep, F.col(c)), p))
    floor_, ceil_ = F.percentile("ver", 0.03), F.percentile("ver", 0.97)
    return at.groupBy(*keys, "d_idx").agg(
        F.count("*").alias("n"), side("lat", 0.03, F.col("lat") < -wall).alias("x_left"), side("lat", 0.97, F.col("lat") > wall).alias("x_right"),
        F.when((floor_ > -3.0) & (floor_ < 0.6), floor_).alias("z_floor"), F.when((ceil_ > 0.5) & (ceil_ < 6.0), ceil_).alias("z_ceil"),
    ).where(F.col("n") >= least)


def normals(curve: DataFrame, keys: list[str], d: str, x: str) -> DataFrame:
    """curve with the unit normal (n_x, n_d) of x(d): central differences, one-sided at the ends."""
    by = Window.partitionBy(*keys).orderBy(d)
    slope = (F.coalesce(F.lead(x).over(by), F.col(x)) - F.coalesce(F.lag(x).over(by), F.col(x))) / (F.coalesce(F.lead(d).over(by), F.col(d)) - F.coalesce(F.lag(d).over(by), F.col(d)))
    n = F.sqrt(1 + F.col("_g") * F.col("_g"))
    return curve.withColumn("_g", slope).withColumns({"n_x": 1 / n, "n_d": -F.col("_g") / n}).drop("_g")


def window_excess(cells: DataFrame, keys: list[str], rows: int, columns: int) -> DataFrame:
    """(keys, d_bin, y_bin, n): sums of all windows of rows x columns cells that hold a cell, named by their first cell.

    A window is a sum over columns of sums over rows, so a cell is emitted
    rows + columns times, not once for each window that it lies in.
    """
    def slid(part: DataFrame, c: str, width: int) -> DataFrame:
        moved = part.withColumn(c, F.explode(F.sequence(F.col(c) - (width - 1), F.col(c))))
        return moved.groupBy(*keys, "d_bin", "y_bin").agg(F.sum("n").alias("n"))

    return slid(slid(cells.select(*keys, "d_bin", "y_bin", "n"), "y_bin", columns), "d_bin", rows)
