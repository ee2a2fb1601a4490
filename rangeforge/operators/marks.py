"""Bright marks off the laser lines: what they are, which are near, and how far. Rules on one row a frame, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a frame gives: each mark with the distances it would have as a point, as a line, and beyond the map; side lines; the nearest bottom line.
MARKS = "array<struct<x:double,y:double,area:long,width:long,height:long,at_point:double,at_line:double,beyond:double>>"
LINE = "struct<a:double,b:double,c:double>"


def _kind(m: Column) -> Column:
    w, h = m["width"], m["height"]
    thin = lambda short, long: (long >= 30) & (short <= F.greatest(F.lit(10.0), 0.4 * long))
    return F.when(F.greatest(w, h) <= 24, "dot").when(thin(h, w), "hline").when(thin(w, h), "vline").otherwise("blob")


def _off(line: Column, m: Column) -> Column:
    return F.abs(line["a"] * m["x"] + line["b"] * m["y"] + line["c"])


def _in_corridor(m: Column, sides: Column, width: int) -> Column:
    """Between the side lines at the mark's height, 20 pixels to spare; in the middle half where there are none."""
    walls = F.transform(F.filter(sides, lambda s: F.abs(s["a"]) > 1e-9), lambda s: -(s["b"] * m["y"] + s["c"]) / s["a"])
    return m["x"].between(F.coalesce(F.array_min(walls) - 20, F.lit(0.25 * width)), F.coalesce(F.array_max(walls) + 20, F.lit(0.75 * width)))


def _in_place(m: Column, width: int, height: int) -> Column:
    """Lying marks in the middle half of the width, upright ones in that of the height, dots below the top quarter."""
    lying = (m["kind"] == "hline") | ((m["kind"] == "blob") & (m["width"] > m["height"]))
    upright = (m["kind"] == "vline") | ((m["kind"] == "blob") & (m["height"] > m["width"]))
    return (
        (~lying | m["x"].between(0.25 * width, 0.75 * width))
        & (~upright | m["y"].between(0.25 * height, 0.75 * height))
        & ((m["kind"] != "dot") | (m["y"] >= 0.25 * height))
    )


def _broken(m: Column, sides: Column, marks: Column) -> Column:
    """A dot on a side line along which dots are spread over 30 pixels: that line in pieces."""
    on = lambda s, v: (v["kind"] == "dot") & (_off(s, v) <= 12)
    along = lambda s: F.transform(F.filter(marks, lambda v: on(s, v)), lambda v: v["y"] * s["a"] - v["x"] * s["b"])
    return F.exists(sides, lambda s: on(s, m) & (F.array_max(along(s)) - F.array_min(along(s)) >= 30))


def near_marks(frames: DataFrame, *, width: int = 1280, height: int = 720) -> DataFrame:
    """frames with `near`, an array of (kind, x, y, area, near, d), those with a distance first, nearest first, and `closest` brought down to them.

    Takes columns marks, sides, bottom (null: none), readings and closest, and
    drops the first three. A dot or flat mark below the bottom line is near, and
    has the distance of a point or of a line, else the one beyond the map. A dot
    that is near but that no reading within half a metre before to two behind
    supports is not near after all. Empty arrays give an empty array.
    """

    def placed(m: Column) -> Column:
        floor_ = F.when(F.abs("bottom.b") > 1e-9, 6 - (F.col("bottom.a") * m["x"] + F.col("bottom.c")) / F.col("bottom.b"))
        below = m["kind"].isin("dot", "hline") & (m["y"] > F.coalesce(floor_, F.lit(0.75 * height)))
        return m.withField("near", below).withField("d", F.when(below, F.coalesce(F.when(m["kind"] == "dot", m["at_point"]).otherwise(m["at_line"]), m["beyond"])))

    def told(m: Column) -> Column:
        lonely = (m["kind"] != "hline") & m["d"].isNotNull() & (F.size("readings") > 0) & ~F.exists("readings", lambda r: r.between(m["d"] - 0.5, m["d"] + 2))
        return F.struct(m["kind"].alias("kind"), m["x"].alias("x"), m["y"].alias("y"), m["area"].alias("area"), (m["near"] & ~lonely).alias("near"), m["d"].alias("d"))

    kinds = frames.withColumn("marks", F.transform("marks", lambda m: m.withField("kind", _kind(m))))
    kept = kinds.withColumn("marks", F.transform(F.filter("marks", lambda m: _in_corridor(m, F.col("sides"), width) & _in_place(m, width, height)), placed))
    whole = kept.withColumn("marks", F.filter("marks", lambda m: ~_broken(m, F.col("sides"), F.col("marks"))))
    ranked = F.array_sort(F.transform("marks", lambda m, k: F.struct(m["d"].isNull().alias("none"), m["d"].alias("d"), k.alias("k"), told(m).alias("mark"))))
    near = whole.withColumn("near", F.transform(ranked, lambda r: r["mark"])).drop("marks", "sides", "bottom")
    nearest = F.array_min(F.transform(F.filter("near", lambda m: m["near"]), lambda m: m["d"]))
    return near.withColumn("closest", F.least("closest", nearest))
