"""Keyed histograms, z-buffers and extents over binned planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid, ShadowConfig
from ..functions.geometry import angular, bin_index, half_even, perspective
from .quantiles import exact_percentiles

OPEN, LIT, OCCLUDED = 0, 1, 2


def in_grid(u: Column, v: Column, grid: Grid) -> Column:
    """Half-open test against a grid's extent."""
    return (u >= grid.u_lo) & (u < grid.u_hi) & (v >= grid.v_lo) & (v < grid.v_hi)


def plane_cells(points: DataFrame, d0: float, grid: Grid, f_min: float = 0.3) -> DataFrame:
    """points with the cell (iu, iv) that each hits on the plane at d0; points behind f_min or off the grid go."""
    u, v = perspective(F.col("lat"), F.col("ver"), F.col("f"), d0)
    return points.where(F.col("f") > f_min).withColumns({"u": u, "v": v}).where(in_grid(F.col("u"), F.col("v"), grid)).withColumns({"iu": bin_index(F.col("u"), grid.u_lo, grid.res), "iv": bin_index(F.col("v"), grid.v_lo, grid.res)})


def z_buffer(cells: DataFrame, keys: list[str], d0: float) -> DataFrame:
    """State of each cell hit: lit if its nearest point lies beyond the plane, else occluded. Cells without a row are open."""
    return cells.groupBy(*keys, "iu", "iv").agg(F.min("f").alias("f_min")).withColumn("st", F.when(F.col("f_min") > d0, LIT).otherwise(OCCLUDED))


def state_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.sum((F.col("st") == LIT).cast("long")).alias("lit_px"), F.sum((F.col("st") == OCCLUDED).cast("long")).alias("occluded_px"))


def screen_histogram(points: DataFrame, screens: list[float], gap: float, grid: Grid) -> DataFrame:
    """(D, iu, iv, n): for each screen D, points beyond D + gap projected onto it. Each point is emitted once a screen it passes."""
    many = points.withColumn("D", F.explode(F.filter(F.array(*map(F.lit, screens)), lambda d: F.col("f") > d + gap)))
    u, v = perspective(F.col("lat"), F.col("ver"), F.col("f"), F.col("D"))
    hit = many.withColumns({"u": u, "v": v}).where(in_grid(F.col("u"), F.col("v"), grid))
    return hit.groupBy("D", bin_index(F.col("u"), grid.u_lo, grid.res).alias("iu"), bin_index(F.col("v"), grid.v_lo, grid.res).alias("iv")).agg(F.count("*").alias("n"))


def angular_screens(points: DataFrame, thresholds: list[float], width: float, grid: Grid) -> DataFrame:
    """(threshold, ia, ib, n): angular histogram of the points beyond each threshold."""
    a, b = angular(F.col("lat"), F.col("ver"), F.col("f"))
    many = points.where("f > 0").withColumns({"a": a, "b": b}).where(in_grid(F.col("a"), F.col("b"), grid)).withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("f") > t)))
    return many.groupBy("threshold", bin_index(F.col("a"), grid.u_lo, width).alias("ia"), bin_index(F.col("b"), grid.v_lo, width).alias("ib")).agg(F.count("*").alias("n"))


def projection_rows(points: DataFrame, step: float, d_max: float, u_max: float, width: float) -> DataFrame:
    """(row, iu, n): each point counts in every row D <= f (D = step * row, row 0 included) at its place projected onto that row."""
    last = F.least(F.floor(F.col("f") / step), F.lit(int(d_max / step))).cast("int")
    many = points.where("f > 0").withColumn("row", F.explode(F.sequence(F.lit(0), last)))
    u = F.col("lat") * (F.col("row") * step) / F.col("f")
    return many.withColumn("u", u).where((F.col("u") >= -u_max) & (F.col("u") < u_max)).groupBy("row", bin_index(F.col("u"), -u_max, width).alias("iu")).agg(F.count("*").alias("n"))


def occupancy(points: DataFrame, d_bin: float, y_bin: float, d_max: float, y_max: float, keys: list[str] | None = None) -> DataFrame:
    """(d_bin, y_bin, n) over all frames; no epsilon."""
    inside = points.where((F.col("f") >= 0) & (F.col("f") < d_max) & (F.abs("lat") < y_max))
    return inside.groupBy(*(keys or []), bin_index(F.col("f"), 0.0, d_bin, 0.0).alias("d_bin"), bin_index(F.col("lat"), -y_max, y_bin, 0.0).alias("y_bin")).agg(F.count("*").alias("n"))


def stacked(frames: DataFrame, size: int, step: int) -> DataFrame:
    """Rows once for each stack that holds their frame: stack s takes frames s * step to s * step + size - 1."""
    last = F.floor(F.col("frame_idx") / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame_idx") - (size - 1)) / step))
    return frames.where(first <= last).withColumn("stack", F.explode(F.sequence(first, last)))


def lateral_profile(points: DataFrame, slabs: list[float], thickness: float, lo: float, width: float, keys: list[str]) -> DataFrame:
    """(keys, D, bin, n) of points in the slab [D - thickness, D], both ends in."""
    many = points.withColumn("D", F.explode(F.filter(F.array(*map(F.lit, slabs)), lambda d: (F.col("f") >= d - thickness) & (F.col("f") <= d))))
    return many.groupBy(*keys, "D", bin_index(F.col("lat"), lo, width).alias("bin")).agg(F.count("*").alias("n"))


def profile_edges(profile: DataFrame, keys: list[str], at_least: int = 5) -> DataFrame:
    """First and last bin of each profile that has at least `at_least` bins with a count."""
    return profile.where("n > 0").groupBy(*keys).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n_bins")).where(F.col("n_bins") >= at_least)


def attribute_section(points: DataFrame, slabs: list[float], thickness: float, scale: float) -> DataFrame:
    """(D, s, y, n): attribute value, rounded half to even, against lateral place in each slab."""
    many = points.withColumn("D", F.explode(F.filter(F.array(*map(F.lit, slabs)), lambda d: (F.col("f") >= d - thickness) & (F.col("f") <= d))))
    return many.groupBy("D", half_even(F.col("intensity") / scale).cast("long").alias("s"), F.col("lat").cast("int").alias("y")).agg(F.count("*").alias("n"))


def topdown_running(points: DataFrame, res: float, key: str = "bag") -> DataFrame:
    """(key, frame_idx, i_f, i_lat, n, running): density of each frame and its running sum over frames."""
    cells = points.groupBy(key, "frame_idx", bin_index(F.col("f"), 0.0, res).alias("i_f"), F.floor(F.col("lat") / res).cast("int").alias("i_lat")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key, "i_f", "i_lat").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("running", F.sum("n").over(order))


def nearest_wins(rows: DataFrame, pixel: list[str], depth: str, tie: str, values: list[str]) -> DataFrame:
    """For each pixel the row of least depth, ties by `tie`."""
    best = F.min_by(F.struct(depth, *values), F.struct(depth, tie)).alias("best")
    return rows.groupBy(*pixel).agg(best).select(*pixel, *[F.col(f"best.{c}").alias(c) for c in (depth, *values)])


def static_cells(cells: DataFrame, image: str, at_least: int) -> DataFrame:
    """Cells lit in at least so many images."""
    return cells.groupBy("iu", "iv").agg(F.count_distinct(image).alias("images")).where(F.col("images") >= at_least)


def extent(points: DataFrame, d0: float, margin: float, least: int = 50) -> DataFrame:
    """One row: 1st and 99th percentile of the projected points beyond d0, widened; all points if fewer than `least` are beyond."""
    u, v = perspective(F.col("lat"), F.col("ver"), F.col("f"), d0)
    seen = points.where("f > 0.3").withColumns({"u": u, "v": v, "far": F.col("f") > d0})
    n_far = seen.where("far").count()
    kept = seen.where("far") if n_far >= least else seen
    long = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("x")) for c in "uv"])).alias("a")).select("a.*")
    q = exact_percentiles(long, ["axis"], "x", [0.01, 0.99])
    at = lambda c, k: F.max(F.when(F.col("axis") == c, F.col("q")[k]))
    return q.agg(*[(at(c, k) + (margin if k else -margin)).alias(f"{c}_{('lo', 'hi')[k]}") for c in "uv" for k in (0, 1)], F.lit(n_far).cast("long").alias("n_far"))


def project_frames(points: DataFrame, config: ShadowConfig, grid: Grid, keys: list[str]) -> DataFrame:
    """Decision-plane states of each frame."""
    return z_buffer(plane_cells(points, config.d0, grid, config.f_min), keys, config.d0)


def live_mask(states: DataFrame, boot: int, share: float, walls: list[tuple[int, int]], size: tuple[int, int]) -> DataFrame:
    """(iu, iv, lit): cells of a plane of `size` that are lit, themselves or one beside them, in at least `share` of the first `boot` frames, but for rows iv within a wall's band."""
    from .windows import dilated

    first = states.select("frame_idx").distinct().orderBy("frame_idx").limit(boot)
    near = dilated(states.where(F.col("st") == LIT).join(F.broadcast(first), "frame_idx"), ["frame_idx"]).where(F.col("iu").between(0, size[0] - 1) & F.col("iv").between(0, size[1] - 1))
    lit = near.groupBy("iu", "iv").agg(F.count_distinct("frame_idx").alias("lit"))
    kept = lit.where(F.col("lit") >= share * boot)
    for lo, hi in walls:
        kept = kept.where(~F.col("iv").between(lo, hi))
    return kept


def sample_geometry(lines: DataFrame, centre: tuple[float, float], theta_step: float, first: float = 0.0, last: float = 360.0) -> DataFrame:
    """(fan, d_idx, theta_idx, px, py): the pixel of each matrix cell, where the ray at an angle meets a distance's line; cells off the image are left out."""
    from ..functions.geometry import ray_sheet

    rank = F.dense_rank().over(Window.partitionBy("fan").orderBy("d")) - 1
    angles = F.explode(F.sequence(F.lit(0), F.lit(int(round((last - first) / theta_step)) - 1)))
    rows = lines.withColumn("d_idx", rank.cast("int")).withColumn("theta_idx", angles)
    hit = rows.withColumn("p", ray_sheet(centre[0], centre[1], F.lit(first) + F.col("theta_idx") * theta_step, F.col("line")))
    # An image's last pixel ends at its middle here: what lies beyond would be rounded to a pixel that isn't there.
    return hit.where("p.x <= 1279 AND p.y <= 719").select("fan", "d_idx", "theta_idx", F.rint("p.x").cast("int").alias("px"), F.rint("p.y").cast("int").alias("py"))
