"""Joins on ranges, nearest values and overlaps. Bounded tables (calibration nodes, line maps) are broadcast after their size is checked."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import calibration_line, line_distance
from ..sources.calibration import with_intervals

#: Rows up to which a dimension table is broadcast; larger ones take a bucketed join.
BROADCAST_ROWS = 100_000
#: Side of the cells of the index of lines, and how far from the image's origin it reaches, in pixels.
CELL, REACH = 16.0, 1e6


def dimension(table: DataFrame) -> DataFrame:
    """table marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table


def interpolate_line(rows: DataFrame, nodes: DataFrame, d: str, fan: str = "fan") -> DataFrame:
    """rows with x0 and m of their fan's line at distance d: linear between the nodes around it, the end node's beyond.

    Both sides are keyed by (fan, whole metre), so the bracketing join is an
    equi-join; a bracket is listed under every metre that it touches.
    """
    brackets = with_intervals(nodes).where("d1 IS NOT NULL").select(F.col("fan").alias("_fan"), F.col("d").alias("_d0"), "d1", F.col("x0").alias("_x0"), "x1", F.col("m").alias("_m0"), "m1")
    ends = nodes.groupBy(F.col("fan").alias("_efan")).agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    held = rows.join(dimension(ends), rows[fan] == F.col("_efan")).withColumn("_at", F.greatest("_lo", F.least("_hi", F.col(d))))
    cells = brackets.withColumn("_cell", F.explode(F.sequence(F.floor("_d0"), F.floor("d1"))))
    hit = held.withColumn("_c", F.floor("_at")).join(dimension(cells), (F.col("_c") == F.col("_cell")) & (F.col(fan) == F.col("_fan")) & (F.col("_at") >= F.col("_d0")) & ((F.col("_at") < F.col("d1")) | ((F.col("_at") == F.col("_hi")) & (F.col("d1") == F.col("_hi")))))
    t = (F.col("_at") - F.col("_d0")) / (F.col("d1") - F.col("_d0"))
    out = hit.withColumns({"x0": F.col("_x0") + t * (F.col("x1") - F.col("_x0")), "m": F.col("_m0") + t * (F.col("m1") - F.col("_m0"))})
    return out.select(*rows.columns, "x0", "m")


def dense_lines(nodes: DataFrame, lo: float, hi: float, step: float) -> DataFrame:
    """(fan, d, line): interpolated lines on a grid of distances."""
    spark = nodes.sparkSession
    grid = spark.range(int(round((hi - lo) / step)) + 1).select((F.lit(lo) + F.col("id") * step).alias("d"))
    rows = nodes.select("fan", "vertical").distinct().crossJoin(grid)
    return interpolate_line(rows, nodes, "d").select("fan", "d", calibration_line(F.col("vertical"), F.col("m"), F.col("x0")).alias("line"))


def _places(probes: list[tuple]) -> Column:
    """The cells in which the probes lie, as one value; null if one of them lies nowhere or out of reach."""
    values = [v for p in probes for v in p]
    within = reduce(operator.and_, [F.abs(v) <= REACH for v in values])
    return F.when(within, F.array(*[F.floor(v / CELL) for v in values]))


def _miss(line: Column, probes: list[tuple]) -> Column:
    """How far the farthest probe lies from a line."""
    misses = [F.abs(line_distance(line, x, y)) for x, y in probes]
    return misses[0] if len(misses) == 1 else F.greatest(*misses)


def line_index(places: DataFrame, grid: DataFrame, probes: int) -> DataFrame:
    """(place, fan, near): for each place the lines of a fan that can be nearest to probes which lie in its cells.

    A probe is at most half a diagonal away from the middle of its cell, so a
    line that is farther from the middles than another one by more than both
    may differ is never nearest. Null places keep the whole grid.
    """
    packed = grid.groupBy("fan").agg(F.sort_array(F.collect_list(F.struct("d", "line"))).alias("g"))
    middle = lambda k: (F.col("place")[k] + 0.5) * CELL
    middles = [(middle(2 * k), middle(2 * k + 1)) for k in range(probes)]
    slack = lambda line: CELL * math.sqrt(0.5) * F.sqrt(line["a"] * line["a"] + line["b"] * line["b"]) + 1e-6
    least = F.array_min(F.transform("g", lambda g: _miss(g["line"], middles) + slack(g["line"])))
    # The bound is bound to a variable of its own, so that it isn't computed again for each line.
    kept = F.transform(F.array(least), lambda bound: F.filter("g", lambda g: _miss(g["line"], middles) - slack(g["line"]) <= bound))[0]
    return places.crossJoin(dimension(packed)).select("place", "fan", F.when(F.col("place").isNull(), F.col("g")).otherwise(kept).alias("near"))


def _nearest_in_grid(rows: DataFrame, keys: list[str], probes: list[tuple], grid: DataFrame, name: str) -> DataFrame:
    """(keys, fan, d, name): the distance of each fan whose line misses the probes least, ties to the smaller d.

    The grid is looked through once for each place that occurs, of which an
    image has a bounded number, not once for each row. A row that lies nowhere
    gets the first d with a null miss.
    """
    placed = rows.withColumn("_place", _places(probes))
    index = line_index(placed.select(F.col("_place").alias("place")).distinct(), grid, len(probes))
    best = F.array_min(F.transform("near", lambda g: F.struct(_miss(g["line"], probes).alias("miss"), g["d"].alias("d"))))
    found = placed.join(dimension(index), F.col("_place").eqNullSafe(F.col("place"))).select(*keys, "fan", best.alias("_b"))
    return found.select(*keys, "fan", F.col("_b.d").alias("d"), F.col("_b.miss").alias(name))


def nearest_line(pixels: DataFrame, keys: list[str], lines: DataFrame, x: str, y: str, most: float | None = None) -> DataFrame:
    """(keys, fan, d, residual): for each pixel and fan the distance whose line is nearest, ties to the smaller d."""
    out = _nearest_in_grid(pixels, keys, [(F.col(x), F.col(y))], lines, "residual")
    return out if most is None else out.where(F.col("residual") <= most)


def fit_line_distance(lines: DataFrame, keys: list[str], grid: DataFrame, line: str, span: float = 100.0) -> DataFrame:
    """(keys, fan, d, error): map distance whose line is nearest to a measured one, by the greater error of two probes, `span` to both sides of its point nearest to the image's origin."""
    a, b, c = (F.col(f"{line}.{k}") for k in "abc")
    probes = [(s * b - a * c, -s * a - b * c) for s in (span, -span)]  # they lie on the measured line, so only the map's line counts
    return _nearest_in_grid(lines, keys, probes, grid, "error")


def supported(features: DataFrame, readings: DataFrame, keys: list[str], d: str, below: float = 0.5, above: float = 2.0, exempt: Column | None = None) -> DataFrame:
    """features with a reading in [d - below, d + above] of the same keys; exempt ones stay anyway."""
    r = readings.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(d).alias("_r"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_r") >= F.col(d) - below, F.col("_r") <= F.col(d) + above]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    if exempt is None:
        return features.join(r, condition, "left_semi")
    return features.where(exempt).unionByName(features.where(~exempt).join(r, condition, "left_semi"))


def overlapping_before(boxes: DataFrame, keys: list[str], frame: str, lags: int, grow: float, cell: float) -> DataFrame:
    """(keys, frame, box_id, lags_met): boxes that overlap a box, both grown by `grow`, in how many of the `lags` frames before.

    Boxes are listed under the coarse cells they touch, so overlap is an
    equi-join on (keys, frame, cell) and then a test. Boxes whose grown edges
    meet exactly touch, so the cells reach a little further than the test.
    """
    at = lambda lo, hi, g: F.explode(F.sequence(F.floor((F.col(lo) - g) / cell - 1e-6), F.floor((F.col(hi) + g) / cell + 1e-6)))
    now = boxes.withColumn("_lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_past", F.col(frame) - F.col("_lag")).withColumn("_cx", at("x_lo", "x_hi", 2 * grow))
    past = boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(frame).alias("_pf"), *[F.col(c).alias(f"_{c}") for c in ("x_lo", "x_hi", "y_lo", "y_hi")], at("x_lo", "x_hi", 0.0).alias("_pcx"))
    on = (F.col("_past") == F.col("_pf")) & (F.col("_cx") == F.col("_pcx"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    lo, hi = lambda c: F.col(c) - grow, lambda c: F.col(c) + grow
    touch = (lo("_x_lo") <= hi("x_hi")) & (hi("_x_hi") >= lo("x_lo")) & (lo("_y_lo") <= hi("y_hi")) & (hi("_y_hi") >= lo("y_lo"))
    return now.join(past, on).where(touch).groupBy(*keys, frame, "box_id").agg(F.count_distinct("_lag").alias("lags_met"))


def surface_of(points: DataFrame, model: DataFrame, width: float, tolerance: float, first: float = 0.0) -> DataFrame:
    """points with `surface`: names of the model's surfaces nearer than `tolerance` in their distance bin, joined by ' + ', else other.

    Bins begin at distance `first`; what lies before or behind them takes the
    first or last one. A wall counts on its own side only. A point without a
    distance has none.
    """
    m = model.select(F.col("d_idx").alias("_i"), F.col("x_left").alias("_l"), F.col("x_right").alias("_r"), F.col("z_floor").alias("_f"), F.col("z_ceil").alias("_c"))
    near = lambda c, v, name, side=F.lit(True): F.when(side & (F.abs(F.col(c) - F.col(v)) < tolerance), F.lit(name))
    names = F.concat_ws(" + ", near("lat", "_l", "left", F.col("lat") < 0), near("lat", "_r", "right", F.col("lat") > 0), near("ver", "_f", "floor"), near("ver", "_c", "ceiling"))
    last = m.agg(F.max("_i")).first()[0]
    place = F.floor((F.col("f") - first) / width)
    joined = points.withColumn("_b", F.when(place.isNotNull(), F.least(F.lit(last), F.greatest(F.lit(0), place)))).join(dimension(m), F.col("_b") == F.col("_i"), "left")
    return joined.withColumn("surface", F.when(F.col("_i").isNotNull(), F.when(names == "", "other").otherwise(names))).select(*points.columns, "surface")


def junk_removed(cells: DataFrame, mask: DataFrame, *, compat: bool = False) -> DataFrame:
    """Matrix cells off the mask. compat: instead keeps the lowest bit of every count, so cells of two families vanish and of three count one."""
    if compat:
        return cells.withColumn("n", F.col("n").bitwiseAND(1)).where("n > 0").join(mask, ["d_idx", "theta_idx"], "left_anti")
    return cells.join(mask, ["d_idx", "theta_idx"], "left_anti")


def sampled_cells(geometry: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, d_idx, theta_idx, n): families (at most 3) whose pixel of a matrix cell is set in the mask; pixels that the mask names twice count once.

    A geometry of up to BROADCAST_ROWS cells is broadcast, so the mask moves
    only as cells already counted in part; a larger one is joined by pixel.
    """
    hit = mask.select(*keys, F.col("x").alias("px"), F.col("y").alias("py")).join(dimension(geometry), ["px", "py"])
    return hit.groupBy(*keys, "d_idx", "theta_idx").agg(F.least(F.size(F.collect_set("fan")), F.lit(3)).cast("long").alias("n"))


def fallback(rows: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with value from the first table that has one, and where it came from."""
    a = first.select(*keys, F.col(value).alias("_a"))
    b = second.select(*keys, F.col(value).alias("_b"))
    return rows.join(a, keys, "left").join(b, keys, "left").select(*rows.columns, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "map").when(F.col("_b").isNotNull(), "model").alias("source"))


def assign_fans(candidates: DataFrame, keys: list[str], name: str, left: str, right: str, most: float = 10.0) -> DataFrame:
    """(keys, left_of, right_of): candidate of least left error, then of least right error among the rest; each only under `most`."""
    first = candidates.groupBy(*keys).agg(F.min_by(F.struct(F.col(name).alias("n"), F.col(left).alias("e")), F.struct(left, name)).alias("_l"))
    rest = candidates.join(first, keys).where(F.col(name) != F.col("_l.n")).groupBy(*keys).agg(F.min_by(F.struct(F.col(name).alias("n"), F.col(right).alias("e")), F.struct(right, name)).alias("_r"))
    ok = lambda c: F.when(F.col(f"{c}.e") < most, F.col(f"{c}.n"))
    return first.join(rest, keys, "left").select(*keys, ok("_l").alias("left_of"), ok("_r").alias("right_of"))


def ranked(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def matched_segments(details: DataFrame, segments: DataFrame, keys: list[str], within: float = 1.5) -> DataFrame:
    """details with the segment of the same point count whose middle lies within `within` pixels; the first by name of several."""
    s = segments.select(*keys, F.col("n").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("segment_id").alias("_s"))
    on = [details[k] == s[k] for k in keys] + [details["n"] == s["_n"], F.abs(details["x"] - s["_x"]) <= within, F.abs(details["y"] - s["_y"]) <= within]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    hit = details.join(s, condition).groupBy(*[details[c] for c in details.columns]).agg(F.min("_s").alias("segment_id"))
    return hit


def corner_of(side: DataFrame, bottom: DataFrame, keys: list[str], margin: float = 15.0) -> DataFrame:
    """(keys, x, y, depth): where a frame's nearest side segment crosses a bottom segment inside both extents; the nearest bottom distance.

    Segments are (keys, line, x_lo, x_hi, y_lo, y_hi, d), a few to a frame.
    """
    from ..functions.geometry import cross_lines

    near = side.groupBy(*keys).agg(F.min_by(F.struct("line", "x_lo", "x_hi", "y_lo", "y_hi"), "d").alias("_s"))
    both = bottom.join(near, keys).withColumn("_p", cross_lines(F.col("_s.line"), F.col("line")))
    inside = lambda p: (F.col("_p.x") >= F.col(f"{p}x_lo") - margin) & (F.col("_p.x") <= F.col(f"{p}x_hi") + margin) & (F.col("_p.y") >= F.col(f"{p}y_lo") - margin) & (F.col("_p.y") <= F.col(f"{p}y_hi") + margin)
    met = both.where(F.col("_p").isNotNull() & inside("") & inside("_s."))
    return met.groupBy(*keys).agg(F.min_by(F.struct("_p.x", "_p.y", "d"), "d").alias("_c")).select(*keys, F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), F.col("_c.d").alias("depth"))
