"""Intensity scales and colour ramps of the render-ready tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_scaled(cells: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """cells with `shade` 0..255: log(1 + v) over its greatest value, of the whole table or of each key."""
    v = F.log1p(F.col(value).cast("double"))
    top = cells.groupBy(*(keys or [])).agg(F.max(v).alias("_top"))
    joined = cells.join(top, keys) if keys else cells.crossJoin(F.broadcast(top))  # one row
    return joined.withColumn("shade", F.when(F.col("_top") > 0, F.floor(255 * v / F.col("_top"))).otherwise(0).cast("int")).drop("_top")


def log10_scaled(value: Column, full: float = 2.0) -> Column:
    """log10(1 + v) over log10(1 + full), within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(1 + value) / F.log10(F.lit(1 + full))))


def density_colour(value: Column, top: Column) -> Column:
    """struct(r, g, b) of a count in a density picture: black, blue, cyan, white with log(1 + n) over its greatest value."""
    x = F.log1p(value.cast("double")) / F.greatest(F.log1p(top.cast("double")), F.lit(1e-6))
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    part = lambda v: (255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))).cast("int")
    return F.struct(part(x * 1.2 - 0.1).alias("r"), part(x * 2.0 - 0.25).alias("g"), part(x * 1.5).alias("b"))


#: Colours of the attribute scale, equal steps apart.
SPECTRUM = (
    (47, 14, 156), (70, 50, 215), (83, 87, 238), (91, 120, 242), (111, 163, 235),
    (144, 194, 225), (194, 217, 197), (233, 232, 137), (251, 229, 63), (249, 188, 30),
    (225, 132, 16), (188, 82, 8), (127, 25, 35), (73, 10, 17), (42, 1, 12),
)


def spectrum(value: Column) -> Column:
    """struct(r, g, b) of a value within 0 and 1: linear between the colours around it, cut to whole numbers."""
    steps = len(SPECTRUM) - 1
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)) * steps
    i = F.least(F.floor(t), F.lit(steps - 1)).cast("int")
    colours = F.array(*[F.array(*map(F.lit, c)) for c in SPECTRUM])
    at = lambda k, c: F.element_at(F.element_at(colours, k + 1), c + 1)
    return F.struct(*[((1 - (t - i)) * at(i, c) + (t - i) * at(i + 1, c)).cast("int").alias(n) for c, n in enumerate("rgb")])


def recording_of(path: Column, folder: str) -> Column:
    """struct(root, name): the part of a path up to and with a folder, and the name that follows."""
    pattern = f"(.*{folder}/)(\\w+)"
    return F.struct(F.regexp_extract(path, pattern, 1).alias("root"), F.regexp_extract(path, pattern, 2).alias("name"))


def thinned_marks(line: Column) -> Column:
    """A line of a character map with its runs of # drawn by their length: under four as dots, under eight as o, longer ones as they are but for one character."""
    runs = F.regexp_extract_all(line, F.lit("(#+|[^#]+)"), 1)
    n = F.length
    return F.array_join(F.transform(runs, lambda r: F.when(~r.startswith("#"), r).when(n(r) < 4, ".").when(n(r) < 8, "o").otherwise("#")), "")


def level(distance: Column, alarm: float = 1.5, warn: float = 3.0) -> Column:
    return F.when(distance.isNull(), "none").when(distance < alarm, "alarm").when(distance < warn, "warn").otherwise("free")


def ascii_rows(cells: DataFrame, row: str, column: str, value: str, width: int, shades: str = " .:-=+*#%@") -> DataFrame:
    """(row, line): one character for each column of a row, darker for higher values of the table."""
    top = cells.agg(F.max(value).alias("_top"))
    shade = F.substring(F.lit(shades), (F.floor(F.col(value) / F.col("_top") * (len(shades) - 1)) + 1).cast("int"), F.lit(1))
    marks = cells.crossJoin(F.broadcast(top)).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), shade))).alias("_m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(" "))), "")
    return marks.select(row, line.alias("line"))
