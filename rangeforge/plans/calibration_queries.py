"""Queries of calibration building, masks and render-ready scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scaling
from ..operators import calibrate, grids
from ..operators import windows as w
from ..sources.driver import MEASURED, POINTS, SIGNAL, measured_nodes, points, signal, table
from .grid_queries import CELLS, states
from .registry import query


@query(
    f"""WITH {POINTS}, o AS (SELECT trunc(f / 2.0)::INT AS d_bin, trunc((lat + 3.5) / 0.1)::INT AS y_bin, count(*) AS n FROM points WHERE f >= 0 AND f < 180 AND abs(lat) < 3.5 GROUP BY ALL)
SELECT d_bin, y_bin, n, floor(255 * ln(1 + n) / (SELECT max(ln(1 + n)) FROM o))::INT AS shade FROM o"""
)
def occupancy_shades(spark, sf_dir):
    return scaling.log_scaled(grids.occupancy(points(spark, sf_dir), 2.0, 0.1, 180.0, 3.5), "n")


COLOURS = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in scaling.SPECTRUM) + "]"


@query(
    f"""WITH {SIGNAL}, v AS (SELECT event_id, d / 500 AS v, least(1.0, greatest(0.0, d / 500)) * 14 AS t FROM signal), i AS (SELECT *, least(floor(t), 13)::INT AS i, {COLOURS} AS c FROM v)
SELECT event_id, CASE WHEN v < 0.003 THEN 'alarm' WHEN v < 0.006 THEN 'warn' ELSE 'free' END AS level, round(least(1.0, greatest(0.0, log10(1 + v) / log10(3.0))), 6) AS shade,
trunc((1 - (t - i)) * c[i + 1][1] + (t - i) * c[i + 2][1])::INT AS r, trunc((1 - (t - i)) * c[i + 1][2] + (t - i) * c[i + 2][2])::INT AS g, trunc((1 - (t - i)) * c[i + 1][3] + (t - i) * c[i + 2][3])::INT AS b FROM i"""
)
def colour_levels(spark, sf_dir):
    v = F.col("d") / 500
    return signal(spark, sf_dir).select("event_id", scaling.level(v, 0.003, 0.006).alias("level"), F.round(scaling.log10_scaled(v), 6).alias("shade"), scaling.spectrum(v).alias("c")).select("event_id", "level", "shade", "c.*")


@query(
    f"""WITH {POINTS}, n AS (SELECT trunc(f)::INT AS d_bin, lat, count(*) AS n FROM points GROUP BY ALL), x AS (SELECT *, ln(1 + n) / (SELECT ln(1 + max(n)) FROM n) AS x FROM n)
SELECT d_bin, lat, trunc(255 * least(1, greatest(0, x * 1.2 - 0.1)))::INT AS r, trunc(255 * least(1, greatest(0, x * 2.0 - 0.25)))::INT AS g, trunc(255 * least(1, greatest(0, x * 1.5)))::INT AS b FROM x"""
)
def density_colours(spark, sf_dir):
    n = points(spark, sf_dir).groupBy(F.col("f").cast("int").alias("d_bin"), "lat").agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("d_bin", "lat", scaling.density_colour(F.col("n"), F.col("top")).alias("c")).select("d_bin", "lat", "c.*")  # top is one row


@query(
    rf"""WITH {SIGNAL}, p AS (SELECT event_id, '/data/recordings/' || fam || '_' || bag || '/part' || frame_idx % 3 || '.db3' AS path, repeat('#', (frame_idx % 12)::INT) || ' ' || repeat('#', (theta % 5)::INT) || '-#' AS line FROM signal)
SELECT event_id, regexp_extract(path, '(.*recordings/)(\w+)', 1) AS root, regexp_extract(path, '(.*recordings/)(\w+)', 2) AS name,
array_to_string(list_transform(regexp_extract_all(line, '#+|[^#]+'), lambda r: CASE WHEN r[1] <> '#' THEN r WHEN len(r) < 4 THEN '.' WHEN len(r) < 8 THEN 'o' ELSE '#' END), '') AS marks FROM p"""
)
def path_and_marks(spark, sf_dir):
    """Recording names parsed from paths, and runs in lines of character maps drawn by their length."""
    path = F.concat(F.lit("/data/recordings/"), "fam", F.lit("_"), "bag", F.lit("/part"), F.col("frame_idx") % 3, F.lit(".db3"))
    line = F.concat(F.expr("repeat('#', cast(frame_idx % 12 AS int))"), F.lit(" "), F.expr("repeat('#', cast(theta % 5 AS int))"), F.lit("-#"))
    p = scaling.recording_of(path, "recordings")
    return signal(spark, sf_dir).select("event_id", p["root"].alias("root"), p["name"].alias("name"), scaling.thinned_marks(line).alias("marks"))


@query(
    f"""WITH {CELLS}, b AS (SELECT DISTINCT frame_idx FROM states ORDER BY frame_idx LIMIT 20), w AS (SELECT DISTINCT frame_idx, iu + a AS iu, iv + c AS iv FROM states, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(c) WHERE st = 1 AND frame_idx IN (SELECT frame_idx FROM b)),
m AS (SELECT iu, iv, count(*) AS lit FROM w WHERE iu BETWEEN 0 AND 19 AND iv BETWEEN 0 AND 15 GROUP BY ALL)
SELECT iu, iv, lit FROM m WHERE lit >= 0.25 * 20 AND NOT (iv BETWEEN 6 AND 8)"""
)
def live_mask(spark, sf_dir):
    """Cells lit, or beside a lit one, in a quarter of the first 20 frames, off the walls' band. The boot phase is the operator's own limit."""
    return grids.live_mask(states(spark, sf_dir), 20, 0.25, [(6, 8)], (20, 16))


@query(
    f"""WITH {MEASURED}, s AS (SELECT fan, d, CASE WHEN fan = 'R' THEN x0 ELSE list_sort([coalesce(lag(x0) OVER o, x0), x0, coalesce(lead(x0) OVER o, x0)])[2] END AS x0,
CASE WHEN fan = 'R' THEN m ELSE list_sort([coalesce(lag(m) OVER o, m), m, coalesce(lead(m) OVER o, m)])[2] END AS m, CASE WHEN fan = 'L' THEN 1 ELSE -1 END AS direction FROM nodes WINDOW o AS (PARTITION BY fan ORDER BY d))
SELECT fan, direction, round(d, 6) AS d, floor(x0 * 1e3 + 0.500001) / 1e3 AS x0, floor(m * 1e6 + 0.500001) / 1e6 AS m FROM s"""
)
def calibration_map(spark, sf_dir):
    """Places lie far enough apart that making them monotone changes nothing; slopes do not."""
    nodes = calibrate.build_map(measured_nodes(spark, sf_dir).select("fan", "d", "x0", "m"))
    return nodes.select("fan", "direction", F.round("d", 6).alias("d"), _cut(F.col("x0"), 3).alias("x0"), _cut(F.col("m"), 6).alias("m"))


def _cut(c, digits: int):
    """Rounded, with what is a half but for the last bits going up on both sides."""
    return F.floor(c * 10.0**digits + 0.500001) / 10.0**digits


SIDES = {"near": "up <= 3", "far": "down <= 3"}
FITS = ", ".join(f"regr_{what}({c}, 1 / d) FILTER ({own}) AS {side}_{c}_{what[0]}" for side, own in SIDES.items() for c in ("x0", "m") for what in ("intercept", "slope"))
HELD = "{c}0 + (p - d0) / (d1 - d0) * ({c}1 - {c}0)"
BLENDED = "CASE WHEN d < lo THEN (1 - w) * ({h}) + w * (near_{c}_i + near_{c}_s / d) WHEN d > hi THEN (1 - w) * ({h}) + w * (far_{c}_i + far_{c}_s / d) ELSE {h} END"


@query(
    f"""WITH {MEASURED}, n AS (SELECT *, row_number() OVER (PARTITION BY fan ORDER BY d) AS up, row_number() OVER (PARTITION BY fan ORDER BY d DESC) AS down FROM nodes),
f AS (SELECT fan, min(d) AS lo, max(d) AS hi, {FITS} FROM n GROUP BY fan),
b AS (SELECT fan, d AS d0, x0 AS x00, m AS m0, lead(d) OVER o AS d1, lead(x0) OVER o AS x01, lead(m) OVER o AS m1 FROM nodes WINDOW o AS (PARTITION BY fan ORDER BY d)),
e AS (SELECT event_id, (['L', 'R', 'B'])[event_id % 3 + 1] AS fan, (floor(value)::BIGINT % 400 + 10) / 20.0::DOUBLE AS d FROM events),
h AS (SELECT e.event_id, e.d, f.*, b.* EXCLUDE (fan), least(greatest(e.d, lo), hi) AS p, CASE WHEN e.d < lo THEN least(1.0, (lo - e.d) / 0.15) ELSE least(1.0, greatest(0.0, (e.d - hi - 0.15) / 0.15)) END AS w
FROM e JOIN f USING (fan) JOIN b ON b.fan = f.fan AND d1 IS NOT NULL AND least(greatest(e.d, lo), hi) >= d0 AND (least(greatest(e.d, lo), hi) < d1 OR (least(greatest(e.d, lo), hi) = hi AND d1 = hi)))
SELECT event_id, fan, d, floor(({BLENDED.format(h=HELD.format(c='x0'), c='x0')}) * 1e3 + 0.500001) / 1e3 AS x0, floor(({BLENDED.format(h=HELD.format(c='m'), c='m')}) * 1e6 + 0.500001) / 1e6 AS m FROM h"""
)
def map_branches(spark, sf_dir):
    """Each event's line at a distance within, before or beyond the measured map."""
    fan = F.element_at(F.array(*map(F.lit, "LRB")), (F.col("event_id") % 3 + 1).cast("int"))
    d = (F.floor("value").cast("long") % 400 + 10) / 20.0
    asked = table(spark, sf_dir, "events").select("event_id", fan.alias("fan"), d.alias("d"))
    return calibrate.branched_lines(asked, measured_nodes(spark, sf_dir), "d").select("event_id", "fan", "d", _cut(F.col("x0"), 3).alias("x0"), _cut(F.col("m"), 6).alias("m"))


@query(
    f"""WITH {MEASURED}, s AS (SELECT a.d, a.x0 AS sx, a.m AS sm, b.x0 AS bx, b.m AS bm FROM nodes a JOIN nodes b ON a.fan = 'L' AND b.fan = 'B' AND a.i = b.i), x AS (SELECT *, (sm * (bx - bm * 640 - 360) + sx) / (1 - sm * bm) AS x FROM s)
SELECT round(d, 6) AS d, round(x, 4) AS x, round(bm * (x - 640) + bx, 4) AS y FROM x"""
)
def corner_line(spark, sf_dir):
    c = calibrate.corner_lines(measured_nodes(spark, sf_dir), "L")
    return c.select(F.round("d", 6).alias("d"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    f"""WITH {POINTS}, o AS (SELECT trunc(f / 2.0)::INT AS d_bin, trunc((lat + 3.5) / 0.1)::INT AS y_bin, count(*) AS n FROM points WHERE f >= 0 AND f < 180 AND abs(lat) < 3.5 GROUP BY ALL),
r AS (SELECT DISTINCT d_bin, y::INT AS y_bin FROM o, range(0, 70) t(y))
SELECT d_bin, string_agg(coalesce(substr(' .:-=+*#%@', floor(n / (SELECT max(n) FROM o)::DOUBLE * 9)::INT + 1, 1), ' '), '' ORDER BY y_bin) AS line FROM r LEFT JOIN o USING (d_bin, y_bin) GROUP BY ALL"""
)
def ascii_map(spark, sf_dir):
    cells = grids.occupancy(points(spark, sf_dir), 2.0, 0.1, 180.0, 3.5)
    return scaling.ascii_rows(cells, "d_bin", "y_bin", "n", 70)


@query(f"WITH {CELLS} SELECT bag, count(DISTINCT iu * 1000 + iv) AS cells, count(DISTINCT frame_idx) AS frames FROM states WHERE st = 1 GROUP BY bag")
def mask_size(spark, sf_dir):
    """Cells of each bag's mask and the frames that made it."""
    lit = states(spark, sf_dir).where("st = 1")
    masks = w.dilated(lit, ["bag"], 0).groupBy("bag").agg(F.count("*").alias("cells"))
    return masks.join(lit.groupBy("bag").agg(F.count_distinct("frame_idx").alias("frames")), "bag")
