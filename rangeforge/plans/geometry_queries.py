"""Queries of the per-row geometry: projections, lines, planes and bins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.driver import POINTS, SIGNAL, points, signal
from .registry import query

CAMERA = (900.0, 900.0, 640.0, 360.0)
#: A line of the image from a signal's distance and angle, in SQL and as columns.
LINE = SIGNAL + ", lines AS (SELECT *, cos(radians(theta)) AS a, sin(radians(theta)) AS b, d - 300 AS c FROM signal)"


def _lines(spark, sf_dir):
    theta = F.radians(F.col("theta").cast("double"))
    return signal(spark, sf_dir).withColumn("line", F.struct(F.cos(theta).alias("a"), F.sin(theta).alias("b"), (F.col("d") - 300).alias("c")))


def r6(c, name):
    """Rounded to six places, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


@query(f"WITH {POINTS} SELECT bag, frame_idx, -f AS y, lat AS x, ver AS z, f AS fwd FROM points")
def canonical_axes(spark, sf_dir):
    from ..config import AxisSpec

    cloud = points(spark, sf_dir).select("bag", "frame_idx", (-F.col("f")).alias("y"), F.col("lat").alias("x"), F.col("ver").alias("z"))
    f, _, _ = g.canonical(AxisSpec())
    return cloud.withColumn("fwd", f)


@query(f"WITH {POINTS} SELECT bag, frame_idx, f, lat, round(hypot_r, 6) AS r, round(degrees(atan2(lat, f)), 6) + 0.0 AS angle FROM (SELECT *, sqrt(f * f + lat * lat) AS hypot_r FROM points)")
def polar_coordinates(spark, sf_dir):
    r, angle = g.polar(-F.col("f"), F.col("lat"))
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", r6(r, "r"), r6(angle, "angle"))


@query(f"WITH {POINTS}, t AS (SELECT bag, frame_idx, f, lat, degrees(atan2(lat - 0.5, f - 25.0)) AS x FROM points) SELECT bag, frame_idx, f, lat, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 6) AS theta FROM t")
def bearing_about_centre(spark, sf_dir):
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", r6(g.bearing_about(F.col("f"), F.col("lat"), 25.0, 0.5), "theta"))


@query(f"WITH {POINTS} SELECT bag, frame_idx, f, lat, ver, CASE WHEN f - 10 > 1e-6 THEN round(lat / (f - 10) * 900 + 640, 6) END AS px, CASE WHEN f - 10 > 1e-6 THEN round(ver / (f - 10) * 900 + 360, 6) END AS py FROM points")
def pinhole_projection(spark, sf_dir):
    px, py = g.pinhole(F.col("lat"), F.col("ver"), F.col("f") - 10, *CAMERA)
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", "ver", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"WITH {LINE} SELECT event_id, round(a * 640 + b * 360 + c, 6) + 0.0 AS dist, CASE WHEN abs(a) > 1e-12 THEN round(-(b * 360 + c) / a, 4) + 0.0 END AS x_mid, CASE WHEN abs(b) > 1e-12 THEN round(-(a * 640 + c) / b, 4) + 0.0 END AS y_mid FROM lines")
def line_readings(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("event_id", r6(g.line_distance(line, 640.0, 360.0), "dist"), (F.round(g.x_at(line, 360.0), 4) + 0.0).alias("x_mid"), (F.round(g.y_at(line, 640.0), 4) + 0.0).alias("y_mid"))


@query(
    f"""WITH {LINE}, p AS (SELECT bag, frame_idx, event_id, a, b, c, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(c) OVER w AS c2 FROM lines WINDOW w AS (PARTITION BY bag ORDER BY frame_idx)),
q AS (SELECT *, a * b2 - a2 * b AS det FROM p WHERE a2 IS NOT NULL)
SELECT event_id, CASE WHEN abs(det) > 1e-9 THEN round((b * c2 - b2 * c) / det, 3) + 0.0 END AS x, CASE WHEN abs(det) > 1e-9 THEN round((a2 * c - a * c2) / det, 3) + 0.0 END AS y FROM q"""
)
def line_intersections(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("bag").orderBy("frame_idx")
    pairs = _lines(spark, sf_dir).withColumn("other", F.lead("line").over(order)).where("other IS NOT NULL")
    met = pairs.withColumn("p", g.cross_lines(F.col("line"), F.col("other")))
    return met.select("event_id", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))


@query(
    f"""WITH {SIGNAL} SELECT event_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM (
SELECT event_id, (d / 100 - (frame_idx % 7)) / 2 AS x, (d / 100 + (frame_idx % 7)) / 2 - 1 AS y, 1.0::DOUBLE AS z FROM signal)"""
)
def plane_intersections(spark, sf_dir):
    d, k = F.col("d") / 100, (F.col("frame_idx") % 7).cast("double")
    p = g.cross_planes([(1.0, 1.0, 1.0, d), (1.0, -1.0, -1.0, -k), (0.0, 0.0, 1.0, F.lit(1.0))])
    return signal(spark, sf_dir).withColumn("p", p).select("event_id", r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"), r6(F.col("p.z"), "z"))


@query(
    f"""WITH {SIGNAL}, p AS (SELECT event_id, d * 2 AS u, (theta + 200)::DOUBLE AS v FROM signal), a AS (SELECT *, (u - 640) / 900 * 0.1 + (v - 360) / 900 * 1.0 + 0.05 AS along FROM p)
SELECT event_id, CASE WHEN abs(along) > 1e-9 AND 1.2 / along > 0.3 AND 1.2 / along < 25 THEN round(1.2 / along, 6) END AS z FROM a"""
)
def ray_plane_depth(spark, sf_dir):
    z = g.ray_plane(F.col("d") * 2, F.col("theta").cast("double") + 200, *CAMERA, 0.1, 1.0, 0.05, 1.2)
    return signal(spark, sf_dir).select("event_id", F.round(z, 6).alias("z"))


@query(
    f"""WITH {LINE}, r AS (SELECT event_id, a, b, c, cos(radians(theta + 40.0)) AS dx, sin(radians(theta + 40.0)) AS dy FROM lines),
t AS (SELECT *, a * dx + b * dy AS den, -(a * 614.0 + b * 225.0 + c) / (a * dx + b * dy) AS t FROM r), p AS (SELECT *, 614.0 + t * dx AS x, 225.0 + t * dy AS y FROM t)
SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM p WHERE abs(den) >= 1e-9 AND t >= 1 AND x >= 0 AND x < 1280 AND y >= 0 AND y < 720"""
)
def ray_sheet_pixels(spark, sf_dir):
    p = g.ray_sheet(614.0, 225.0, F.col("theta") + 40.0, F.col("line"))
    return _lines(spark, sf_dir).withColumn("p", p).where("p IS NOT NULL").select("event_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(
    f"""WITH {POINTS}, r AS (SELECT bag, frame_idx, lat, ver, sqrt(lat * lat + ver * ver) AS r, atan2(ver, lat) + pi() / 2 AS t FROM points)
SELECT least(trunc(r / 8.0 * 96)::INT, 95) AS i_r, least(trunc((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) / (2 * pi()) * 1024)::INT, 1023) AS i_a, count(*) AS n FROM r GROUP BY ALL"""
)
def polar_unroll(spark, sf_dir):
    i_r, i_a = g.unroll(F.col("lat"), F.col("ver"), 96, 1024, 8.0)
    return points(spark, sf_dir).groupBy(i_r.alias("i_r"), i_a.alias("i_a")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {POINTS} SELECT bag, frame_idx, f, lat, round_even(200.0 + lat * 20.0, 0)::INT AS px, round_even(600.0 - f * 10.0, 0)::INT AS py, trunc(f / (f + 6.0) * 600)::INT AS view_row FROM points"""
)
def topdown_pixels(spark, sf_dir):
    px, py = g.topdown_pixel(F.col("f"), F.col("lat") * 2, 10.0, 400, 600)
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", px.alias("px"), py.alias("py"), g.view_row(F.col("f"), 600).alias("view_row"))


@query(
    f"""WITH {POINTS}, o AS (SELECT bag, frame_idx, f, lat, ver, f * {math.cos(math.radians(30))!r} - lat * {math.sin(math.radians(30))!r} AS r, f * {math.sin(math.radians(30))!r} + lat * {math.cos(math.radians(30))!r} AS a FROM points),
p AS (SELECT *, a * {math.cos(math.radians(20))!r} + ver * {math.sin(math.radians(20))!r} + 15.0 AS depth, ver * {math.cos(math.radians(20))!r} - a * {math.sin(math.radians(20))!r} AS up FROM o)
SELECT bag, frame_idx, f, lat, ver, CASE WHEN depth > 0.1 THEN round(r / depth * 500, 5) + 0.0 END AS u, CASE WHEN depth > 0.1 THEN round(up / depth * 500, 5) + 0.0 END AS v FROM p"""
)
def orbit_view(spark, sf_dir):
    u, v = g.orbit(F.col("f"), F.col("lat"), F.col("ver"), 30.0, 20.0, 15.0, 500.0)
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", "ver", (F.round(u, 5) + 0.0).alias("u"), (F.round(v, 5) + 0.0).alias("v"))


@query(
    f"""WITH {SIGNAL}, n AS (SELECT event_id, sin(radians(theta)) AS nx, cos(radians(theta)) AS nz FROM signal)
SELECT event_id, round(degrees(acos(least(abs(0.6 * nx + 0.8 * nz), 1.0))), 4) AS angle FROM n"""
)
def incidence_angles(spark, sf_dir):
    theta = F.radians(F.col("theta").cast("double"))
    return signal(spark, sf_dir).select("event_id", F.round(g.incidence(0.6, 0.0, 0.8, F.sin(theta), F.lit(0.0), F.cos(theta)), 4).alias("angle"))


POSE = (0.12, -0.2, 0.05)


def _pose_sql() -> str:
    """Entries of Rx(pitch) Ry(yaw) Rz(roll) diag(1, -1, 1) as SQL."""
    return """r AS (SELECT cos(p) AS cp, sin(p) AS sp, cos(y) AS cy, sin(y) AS sy, cos(r) AS cr, sin(r) AS sr FROM (SELECT 0.12::DOUBLE AS p, -0.2::DOUBLE AS y, 0.05::DOUBLE AS r)),
m AS (SELECT cy * cr AS m11, cy * sr AS m12, sy AS m13, cp * sr + sp * sy * cr AS m21, -(cp * cr - sp * sy * sr) AS m22, -sp * cy AS m23, sp * sr - cp * sy * cr AS m31, -(sp * cr + cp * sy * sr) AS m32, cp * cy AS m33 FROM r)"""


@query(
    f"""WITH {POINTS}, {_pose_sql()} SELECT bag, frame_idx, f, lat, ver, round(m11 * lat + m12 * ver + m13 * f, 6) + 0.0 AS x, round(m21 * lat + m22 * ver + m23 * f, 6) + 0.0 AS y, round(m31 * lat + m32 * ver + m33 * f, 6) + 0.0 AS z FROM points, m"""
)
def camera_pose(spark, sf_dir):
    """Points turned by a camera's pose."""
    m = g.rotation(*POSE)
    x, y, z = (sum(float(m[i, j]) * F.col(c) for j, c in enumerate(("lat", "ver", "f"))) for i in range(3))
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", "ver", r6(x, "x"), r6(y, "y"), r6(z, "z"))


@query(
    f"""WITH {POINTS}, q AS (SELECT *, lat / f * 900 + 640 AS u0, ver / f * 900 + 360 AS v0, (lat + 1) / (f + 0.5) * 900 + 640 AS u1, (ver + 0.25) / (f + 0.5) * 900 + 360 AS v1 FROM points WHERE f > 0),
n AS (SELECT *, v0 - v1 AS a, u1 - u0 AS b, sqrt((v0 - v1) ** 2 + (u1 - u0) ** 2) AS n FROM q)
SELECT bag, frame_idx, f, lat, ver, CASE WHEN n > 0 THEN round(a / n, 6) + 0.0 END AS a, CASE WHEN n > 0 THEN round(b / n, 6) + 0.0 END AS b, CASE WHEN n > 0 THEN round(-(a * u0 + b * v0) / n, 4) + 0.0 END AS c FROM n"""
)
def image_lines(spark, sf_dir):
    """Image of the line through each point in a fixed direction."""
    line = g.image_line(F.col("lat"), F.col("ver"), F.col("f"), 1.0, 0.25, 0.5, 900.0, 900.0, 640.0, 360.0)
    return points(spark, sf_dir).where("f > 0").withColumn("l", line).select("bag", "frame_idx", "f", "lat", "ver", r6(F.col("l.a"), "a"), r6(F.col("l.b"), "b"), (F.round("l.c", 4) + 0.0).alias("c"))


@query(f"WITH {SIGNAL} SELECT event_id, round(0.3 / sqrt(0.3 ** 2 + 0.9 ** 2), 6) AS a, round(0.9 / sqrt(0.3 ** 2 + 0.9 ** 2), 6) AS b, round((0.2 * d - 0.7) / sqrt(0.3 ** 2 + 0.9 ** 2), 6) + 0.0 AS c FROM signal")
def plane_traces(spark, sf_dir):
    """Where a fan's plane meets a wall at each event's distance."""
    return signal(spark, sf_dir).withColumn("l", g.trace_on_plane(0.3, 0.9, 0.2, 0.7, F.col("d"))).select("event_id", r6(F.col("l.a"), "a"), r6(F.col("l.b"), "b"), r6(F.col("l.c"), "c"))


@query(
    f"""WITH {SIGNAL}, n AS (SELECT event_id, sin(radians(theta)) AS a, 0.3::DOUBLE AS b, cos(radians(theta)) AS c, 0.1::DOUBLE AS d, 1.0::DOUBLE AS e, d / 500 AS f FROM signal),
x AS (SELECT event_id, b * f - c * e AS x, c * d - a * f AS y, a * e - b * d AS z FROM n), u AS (SELECT event_id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM x))
SELECT event_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, CASE WHEN abs(z) > 1e-6 THEN round(x / z * 900 + 640, 3) + 0.0 END AS u, CASE WHEN abs(z) > 1e-6 THEN round(y / z * 900 + 360, 3) + 0.0 END AS v FROM u"""
)
def vanishing_points(spark, sf_dir):
    """Direction in which two planes meet, and the pixel it vanishes in."""
    theta = F.radians(F.col("theta").cast("double"))
    p = signal(spark, sf_dir).withColumn("v", g.vanishing_direction((F.sin(theta), F.lit(0.3), F.cos(theta)), (F.lit(0.1), F.lit(1.0), F.col("d") / 500)))
    u, v = g.vanishing_point(F.col("v"), 900.0, 900.0, 640.0, 360.0)
    return p.select("event_id", *[r6(F.col(f"v.{c}"), c) for c in "xyz"], (F.round(u, 3) + 0.0).alias("u"), (F.round(v, 3) + 0.0).alias("v"))


@query(f"WITH {POINTS} SELECT bag, frame_idx, f, lat, CASE WHEN f > 0.1 THEN floor((400 + lat / f * 300) * 1e4 + 0.500001) / 1e4 END AS u, CASE WHEN f > 0.1 THEN floor((225 - (intensity * 0.0001 - 1.5) / f * 300) * 1e4 + 0.500001) / 1e4 END AS v FROM points")
def pov_pixels(spark, sf_dir):
    """The view from the sensor, heights taken from an attribute."""
    u, v = g.pov(F.col("f"), F.col("lat"), F.col("intensity"), 800.0, 450.0, 300.0, 0.0001, 1.5)
    return points(spark, sf_dir).select("bag", "frame_idx", "f", "lat", *[(F.floor(c * 1e4 + 0.500001) / 1e4).alias(n) for c, n in ((u, "u"), (v, "v"))])


@query(
    f"""WITH {LINE}, s AS (SELECT event_id, CASE WHEN abs(a) > 1e-12 THEN -c / a END AS x0, CASE WHEN abs(a) > 1e-12 THEN -(b * 480 + c) / a END AS x1, CASE WHEN abs(b) > 1e-12 THEN -c / b END AS y0, CASE WHEN abs(b) > 1e-12 THEN -(a * 640 + c) / b END AS y1 FROM lines),
q AS (SELECT event_id, x0 AS x, 0.0::DOUBLE AS y FROM s WHERE x0 BETWEEN 0 AND 640 UNION ALL SELECT event_id, x1, 480.0 FROM s WHERE x1 BETWEEN 0 AND 640 UNION ALL SELECT event_id, 0.0, y0 FROM s WHERE y0 BETWEEN 0 AND 480 UNION ALL SELECT event_id, 640.0, y1 FROM s WHERE y1 BETWEEN 0 AND 480),
e AS (SELECT event_id, min(struct_pack(x := x, y := y)) AS p, max(struct_pack(x := x, y := y)) AS q FROM q GROUP BY event_id HAVING count(*) >= 2)
SELECT event_id, round(p.x, 3) + 0.0 AS x0, round(p.y, 3) + 0.0 AS y0, round(q.x, 3) + 0.0 AS x1, round(q.y, 3) + 0.0 AS y1 FROM e"""
)
def clipped_lines(spark, sf_dir):
    """Lines cut to an image's border."""
    c = _lines(spark, sf_dir).withColumn("p", g.clip_line(F.col("line"), 640.0, 480.0)).where("p IS NOT NULL")
    at = lambda i, n: (F.round(F.col("p")[i][n], 3) + 0.0).alias(f"{n}{i}")
    return c.select("event_id", at(0, "x"), at(0, "y"), at(1, "x"), at(1, "y"))


@query(
    f"""WITH {SIGNAL} SELECT event_id, round(sqrt(d * d + theta * theta), 6) AS r, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 6) AS b FROM (SELECT *, degrees(atan2(theta - 180, d - 100)) AS x FROM signal)"""
)
def sql_functions(spark, sf_dir):
    """The functions that are registered for SQL."""
    from ..functions import registered

    registered.register(spark)
    signal(spark, sf_dir).createOrReplaceTempView("rangeforge_signal")
    return spark.sql("SELECT event_id, round(polar_range(d, theta), 6) AS r, round(bearing_about(d, theta, 100D, 180D), 6) AS b FROM rangeforge_signal")
