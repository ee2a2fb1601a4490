"""Per-row geometry as column expressions: projections, lines, planes, bins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AxisSpec

#: Added before truncation, so that a value on a bin's edge falls into that bin.
EDGE = 1e-6


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def bin_index(value, lo, width, eps: float = EDGE) -> Column:
    """Bin number, truncated toward zero."""
    return ((num(value) - num(lo)) / num(width) + F.lit(eps)).cast("int")


def half_even(value) -> Column:
    return F.rint(num(value))


def canonical(axes: AxisSpec) -> tuple[Column, Column, Column]:
    """(f, lat, ver) of a cloud's own axes."""
    return F.lit(axes.sign) * F.col(axes.forward), F.col(axes.lateral), F.col(axes.vertical)


def perspective(lat, ver, f, d0) -> tuple[Column, Column]:
    """A point seen on the plane at distance d0."""
    return num(lat) * num(d0) / num(f), num(ver) * num(d0) / num(f)


def angular(lat, ver, f) -> tuple[Column, Column]:
    return num(lat) / num(f), num(ver) / num(f)


def polar(x, y) -> tuple[Column, Column]:
    """Range and bearing in degrees; zero bearing looks along -x."""
    return F.hypot(num(x), num(y)), F.degrees(F.atan2(num(y), -num(x)))


def bearing_about(x, y, cx, cy) -> Column:
    """Angle of a point about a centre in degrees, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(num(y) - num(cy), num(x) - num(cx))), F.lit(360.0))


def rotation(pitch: float, yaw: float, roll: float) -> np.ndarray:
    """Camera pose: pitch, then yaw, then roll, with the image's y axis down."""

    def turn(axis: int, angle: float) -> np.ndarray:
        i, j = [k for k in range(3) if k != axis]
        m = np.eye(3)
        m[i, i] = m[j, j] = math.cos(angle)
        m[i, j], m[j, i] = -math.sin(angle), math.sin(angle)
        return m if axis != 1 else m.T

    return turn(0, pitch) @ turn(1, yaw) @ turn(2, roll) @ np.diag([1.0, -1.0, 1.0])


def pinhole(x, y, z, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a camera-frame point; null behind the camera."""
    ahead = num(z) > 1e-6
    return F.when(ahead, num(x) / num(z) * fx + cx), F.when(ahead, num(y) / num(z) * fy + cy)


def image_line(x0, y0, z0, dx, dy, dz, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Normalised (a, b, c) of the image of a 3-D line: the line through the pixels of two of its points."""
    u0, v0 = pinhole(x0, y0, z0, fx, fy, cx, cy)
    u1, v1 = pinhole(num(x0) + dx, num(y0) + dy, num(z0) + dz, fx, fy, cx, cy)
    return line_through(u0, v0, u1, v1)


def line_through(u0, v0, u1, v1) -> Column:
    a, b = num(v0) - num(v1), num(u1) - num(u0)
    n = F.hypot(a, b)
    c = -(a * num(u0) + b * num(v0))
    return F.when(n > 0, F.struct((a / n).alias("a"), (b / n).alias("b"), (c / n).alias("c")))


def trace_on_plane(nx: float, ny: float, nz: float, c: float, d) -> Column:
    """Where a fan's plane n.p = c meets Z = d: the line nx X + ny Y = c - nz d, normalised."""
    n = math.hypot(nx, ny)
    return F.struct(F.lit(nx / n).alias("a"), F.lit(ny / n).alias("b"), ((num(nz) * num(d) - c) / n).alias("c"))


def calibration_line(vertical, m, x0, rows: float = 360.0, columns: float = 640.0) -> Column:
    """(a, b, c) of a calibrated line: side fans x = m (y - rows) + x0, the bottom fan y = m (x - columns) + x0."""
    side = F.struct(F.lit(1.0).alias("a"), (-num(m)).alias("b"), (num(m) * rows - num(x0)).alias("c"))
    flat = F.struct((-num(m)).alias("a"), F.lit(1.0).alias("b"), (num(m) * columns - num(x0)).alias("c"))
    raw = F.when(vertical, side).otherwise(flat)
    n = F.hypot(raw["a"], raw["b"])
    return F.struct((raw["a"] / n).alias("a"), (raw["b"] / n).alias("b"), (raw["c"] / n).alias("c"))


def line_distance(line: Column, x, y) -> Column:
    return line["a"] * num(x) + line["b"] * num(y) + line["c"]


def x_at(line: Column, y) -> Column:
    return F.when(F.abs(line["a"]) > 1e-12, -(line["b"] * num(y) + line["c"]) / line["a"])


def y_at(line: Column, x) -> Column:
    return F.when(F.abs(line["b"]) > 1e-12, -(line["a"] * num(x) + line["c"]) / line["b"])


def cross_lines(p: Column, q: Column) -> Column:
    """struct(x, y) where two lines meet; null for parallel ones."""
    det = p["a"] * q["b"] - q["a"] * p["b"]
    x = F.try_divide(p["b"] * q["c"] - q["b"] * p["c"], det)
    y = F.try_divide(q["a"] * p["c"] - p["a"] * q["c"], det)
    return F.when(F.abs(det) > 1e-9, F.struct(x.alias("x"), y.alias("y")))


def _det3(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def cross_planes(planes) -> Column:
    """struct(x, y, z) where three planes (nx, ny, nz, c) with n.p = c meet; null if they don't in one point."""
    rows = [[num(v) for v in p] for p in planes]
    det = _det3([r[:3] for r in rows])
    part = [F.try_divide(_det3([[r[3] if k == j else r[k] for k in range(3)] for r in rows]), det) for j in range(3)]
    return F.when(F.abs(det) > 1e-9, F.struct(*[p.alias(n) for p, n in zip(part, "xyz", strict=True)]))


def vanishing_direction(p, q) -> Column:
    """Direction in which two planes meet: the cross product of their normals, as a unit struct."""
    (a, b, c), (d, e, f) = ([num(v) for v in n] for n in (p, q))
    x, y, z = b * f - c * e, c * d - a * f, a * e - b * d
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n > 1e-12, F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z")))


def vanishing_point(direction: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel in which lines of a direction vanish; null for directions along the image."""
    z = direction["z"]
    ahead = F.abs(z) > 1e-6
    return F.when(ahead, direction["x"] / z * fx + cx), F.when(ahead, direction["y"] / z * fy + cy)


def ray_plane(u, v, fx, fy, cx, cy, nx, ny, nz, c, near: float = 0.3, far: float = 25.0) -> Column:
    """Depth at which a pixel's ray meets a plane, if between near and far."""
    along = (num(u) - cx) / fx * num(nx) + (num(v) - cy) / fy * num(ny) + num(nz)
    z = F.try_divide(num(c), along)  # the engine may divide before it has looked at `along`
    return F.when((F.abs(along) > 1e-9) & (z > near) & (z < far), z)


def ray_sheet(cx, cy, theta_deg, line: Column, width: float = 1280.0, height: float = 720.0) -> Column:
    """struct(x, y) where the ray from (cx, cy) at an angle meets a line; null off the image, under one pixel away, or along the line."""
    dx, dy = F.cos(F.radians(num(theta_deg))), F.sin(F.radians(num(theta_deg)))
    den = line["a"] * dx + line["b"] * dy
    t = F.try_divide(-line_distance(line, cx, cy), den)
    x, y = num(cx) + t * dx, num(cy) + t * dy
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when((F.abs(den) >= 1e-9) & (t >= 1.0) & inside, F.struct(x.alias("x"), y.alias("y")))


def incidence(dx, dy, dz, nx, ny, nz) -> Column:
    """Angle in degrees between a unit direction and a unit normal, either way round."""
    dot = F.abs(num(dx) * nx + num(dy) * ny + num(dz) * nz)
    return F.degrees(F.acos(F.least(dot, F.lit(1.0))))


def topdown_pixel(f, lat, scale: float, width: int, height: int) -> tuple[Column, Column]:
    return half_even(F.lit(width / 2.0) + num(lat) * scale).cast("int"), half_even(F.lit(float(height)) - num(f) * scale).cast("int")


def view_row(d, height: int, half: float = 6.0) -> Column:
    """Row of a distance in a forward view: d / (d + half) of the height."""
    return (num(d) / (num(d) + half) * height).cast("int")


def orbit(x, y, z, azimuth_deg: float, elevation_deg: float, distance: float, focal: float) -> tuple[Column, Column]:
    """Pixel offsets of a point for a camera that circles the origin; null behind it."""
    a, e = math.radians(azimuth_deg), math.radians(elevation_deg)
    right = num(x) * math.cos(a) - num(y) * math.sin(a)
    ahead = num(x) * math.sin(a) + num(y) * math.cos(a)
    depth = ahead * math.cos(e) + num(z) * math.sin(e) + distance
    up = num(z) * math.cos(e) - ahead * math.sin(e)
    return F.when(depth > 0.1, right / depth * focal), F.when(depth > 0.1, up / depth * focal)


def unroll(u, v, rows: int, columns: int, radius: float) -> tuple[Column, Column]:
    """(radius bin, angle bin) of a plane cell; the angle is turned by a quarter."""
    r = F.hypot(num(u), num(v))
    angle = F.pmod(F.atan2(num(v), num(u)) + math.pi / 2, F.lit(2 * math.pi))
    return F.least((r / radius * rows).cast("int"), F.lit(rows - 1)), F.least((angle / (2 * math.pi) * columns).cast("int"), F.lit(columns - 1))


def clip_line(line: Column, width: float, height: float) -> Column:
    """The two farthest of the points where a line meets an image's border, as array<struct<x, y>>; null under two."""
    def point(x, y):
        inside = (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
        return F.when(inside, F.struct(x.alias("x"), y.alias("y")))

    sides = [point(x_at(line, 0.0), F.lit(0.0)), point(x_at(line, height), F.lit(float(height))), point(F.lit(0.0), y_at(line, 0.0)), point(F.lit(float(width)), y_at(line, width))]
    points = F.array_compact(F.array(*sides))
    first = F.array_min(points)
    last = F.array_max(points)
    return F.when(F.size(points) >= 2, F.array(first, last))


def pov(f, lat, attribute, width: float, height: float, focal: float, scale: float, eye: float = 0.0) -> tuple[Column, Column]:
    """Pixel of a point seen from the sensor, its height taken from an attribute; null behind the sensor."""
    ahead = num(f) > 0.1
    return F.when(ahead, width / 2 + num(lat) / num(f) * focal), F.when(ahead, height / 2 - (num(attribute) * scale - eye) / num(f) * focal)
