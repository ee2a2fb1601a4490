"""Queries of range, nearest and overlap joins, of selection and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from ..operators import matching as m
from ..operators import selection as s
from ..operators import windows as w
from ..sources.calibration import NODES, make_nodes
from ..sources.driver import MEASURED, POINTS, SIGNAL, measured_nodes, points, signal, table
from .grid_queries import CELLS, states
from .registry import query

FAN = "CASE WHEN event_id % 3 = 0 THEN 'L' WHEN event_id % 3 = 1 THEN 'R' ELSE 'B' END"
#: Nodes with brackets, and the interpolated line of a fan at a distance, in SQL.
BRACKETS = NODES + ", br AS (SELECT fan, vertical, d, x0, m, lead(d) OVER o AS d1, lead(x0) OVER o AS x1, lead(m) OVER o AS m1, max(d) OVER (PARTITION BY fan) AS hi, min(d) OVER (PARTITION BY fan) AS lo FROM nodes WINDOW o AS (PARTITION BY fan ORDER BY d))"
GRID = (
    BRACKETS
    + """, g AS (SELECT 2.0::DOUBLE + i * 0.5::DOUBLE AS d FROM range(0, 21) r(i)), gl AS (SELECT br.fan, br.vertical, g.d, br.x0 + (g.d - br.d) / (d1 - br.d) * (x1 - br.x0) AS x0, br.m + (g.d - br.d) / (d1 - br.d) * (m1 - br.m) AS m
FROM g JOIN br ON g.d >= br.d AND g.d < br.d1),
lines AS (SELECT fan, d, CASE WHEN vertical THEN 1.0 ELSE -m END / n AS a, CASE WHEN vertical THEN -m ELSE 1.0 END / n AS b, CASE WHEN vertical THEN m * 360 - x0 ELSE m * 640 - x0 END / n AS c FROM (SELECT *, sqrt(1 + m * m) AS n FROM gl))"""
)


def _fanned(spark, sf_dir):
    fan = F.when(F.col("event_id") % 3 == 0, "L").when(F.col("event_id") % 3 == 1, "R").otherwise("B")
    return signal(spark, sf_dir).select("event_id", fan.alias("fan"), (F.col("d") / 35).alias("d"))


@query(
    f"""WITH {SIGNAL}, {BRACKETS}, e AS (SELECT event_id, {FAN} AS fan, d / 35 AS d FROM signal), h AS (SELECT e.event_id, e.fan, least(greatest(e.d, lo), hi) AS x, br.* EXCLUDE (fan) FROM e JOIN br ON e.fan = br.fan AND d1 IS NOT NULL
AND least(greatest(e.d, lo), hi) >= br.d AND (least(greatest(e.d, lo), hi) < d1 OR (least(greatest(e.d, lo), hi) = hi AND d1 = hi)))
SELECT event_id, fan, floor((x0 + (x - d) / (d1 - d) * (x1 - x0)) * 1e4 + 0.500001) / 1e4 AS x0, round(m + (x - d) / (d1 - d) * (m1 - m), 6) AS m FROM h"""
)
def calib_interpolate(spark, sf_dir):
    out = m.interpolate_line(_fanned(spark, sf_dir), make_nodes(spark), "d")
    return out.select("event_id", "fan", (F.floor(F.col("x0") * 1e4 + 0.500001) / 1e4).alias("x0"), F.round("m", 6).alias("m"))


@query(f"WITH {GRID.replace(NODES, MEASURED)} SELECT fan, d, round(a, 6) AS a, round(b, 6) AS b, round(c, 4) AS c FROM lines")
def dense_line_map(spark, sf_dir):
    out = m.dense_lines(measured_nodes(spark, sf_dir), 2.0, 12.0, 0.5)
    return out.select("fan", "d", F.round("line.a", 6).alias("a"), F.round("line.b", 6).alias("b"), F.round("line.c", 4).alias("c"))


@query(
    f"""WITH {SIGNAL}, {GRID.replace(NODES, MEASURED)},
ray AS (SELECT fan, (dense_rank() OVER (PARTITION BY fan ORDER BY d) - 1)::INT AS d_idx, i::INT AS theta_idx, a, b, c, cos(radians(i)) AS ux, sin(radians(i)) AS uy FROM lines, range(0, 360) r(i)),
met AS (SELECT *, -(a * 620.0::DOUBLE + b * 250.0::DOUBLE + c) / (a * ux + b * uy) AS t FROM ray WHERE abs(a * ux + b * uy) >= 1e-9),
spot AS (SELECT fan, d_idx, theta_idx, 620.0::DOUBLE + t * ux AS x, 250.0::DOUBLE + t * uy AS y FROM met WHERE t >= 1),
geo AS (SELECT fan, d_idx, theta_idx, round_even(x, 0)::INT AS px, round_even(y, 0)::INT AS py FROM spot WHERE x BETWEEN 0 AND 1279 AND y BETWEEN 0 AND 719),
lit AS (SELECT DISTINCT bag, floor(450 + 3 * d)::INT + u.a AS px, (2 * theta)::INT + v.b AS py FROM signal, (VALUES (-1), (0), (1)) u(a), (VALUES (-1), (0), (1)) v(b))
SELECT bag, d_idx, theta_idx, least(count(DISTINCT fan), 3) AS n FROM lit JOIN geo USING (px, py) GROUP BY ALL"""
)
def matrix_samples(spark, sf_dir):
    """Cells of the matrix of distance and angle whose pixels a recording's mask, grown by one pixel, has lit, with the number of fans that see them."""
    geometry = grids.sample_geometry(m.dense_lines(measured_nodes(spark, sf_dir), 2.0, 12.0, 0.5), (620.0, 250.0), 1.0)
    lit = signal(spark, sf_dir).select("bag", F.floor(450 + 3 * F.col("d")).cast("int").alias("iu"), (2 * F.col("theta")).cast("int").alias("iv"))
    mask = w.dilated(lit.distinct(), ["bag"]).select("bag", F.col("iu").alias("x"), F.col("iv").alias("y"))
    return m.sampled_cells(geometry, mask, ["bag"])


@query(
    f"""WITH {SIGNAL}, {GRID}, p AS (SELECT event_id, 400 + d AS x, theta * 2.0 AS y FROM signal), r AS (SELECT event_id, fan, d, abs(a * x + b * y + c) AS r FROM p, lines)
SELECT event_id, fan, arg_min(d, struct_pack(r := r, d := d)) AS d, round(min(r), 4) AS residual FROM r GROUP BY ALL HAVING min(r) <= 60"""
)
def pixel_nearest_line(spark, sf_dir):
    pixels = signal(spark, sf_dir).select("event_id", (F.col("d") + 400).alias("x"), (F.col("theta") * 2.0).alias("y"))
    return m.nearest_line(pixels, ["event_id"], m.dense_lines(make_nodes(spark), 2.0, 12.0, 0.5), "x", "y", 60.0).withColumn("residual", F.round("residual", 4))


@query(
    f"""WITH {SIGNAL}, {GRID}, q AS (SELECT event_id, cos(radians(theta)) AS a, sin(radians(theta)) AS b, d - 300 AS c FROM signal),
o AS (SELECT *, -a * c AS x, -b * c AS y FROM q),
e AS (SELECT o.event_id, g.fan, g.d, greatest(abs(g.a * (x + 100 * o.b) + g.b * (y - 100 * o.a) + g.c), abs(g.a * (x - 100 * o.b) + g.b * (y + 100 * o.a) + g.c)) AS e FROM o, lines g)
SELECT event_id, fan, arg_min(d, struct_pack(e := e, d := d)) AS d, round(min(e), 3) AS error FROM e GROUP BY ALL"""
)
def calib_argmin(spark, sf_dir):
    theta = F.radians(F.col("theta").cast("double"))
    lines = signal(spark, sf_dir).select("event_id", F.struct(F.cos(theta).alias("a"), F.sin(theta).alias("b"), (F.col("d") - 300).alias("c")).alias("line"))
    return m.fit_line_distance(lines, ["event_id"], m.dense_lines(make_nodes(spark), 2.0, 12.0, 0.5), "line").withColumn("error", F.round("error", 3))


@query(
    f"""WITH {SIGNAL}, e AS (SELECT event_id, bag, frame_idx // 5 AS grp, d, fam FROM signal) SELECT event_id FROM e WHERE fam IN ('click', 'view')
AND (fam = 'view' OR EXISTS (SELECT 1 FROM e r WHERE r.fam = 'purchase' AND r.bag = e.bag AND r.grp = e.grp AND r.d >= e.d - 5 AND r.d <= e.d + 20))"""
)
def near_support_semi(spark, sf_dir):
    e = signal(spark, sf_dir).withColumn("grp", F.floor(F.col("frame_idx") / 5)).select("event_id", "bag", "grp", "d", "fam")
    return m.supported(e.where("fam IN ('click', 'view')"), e.where("fam = 'purchase'"), ["bag", "grp"], "d", 5.0, 20.0, F.col("fam") == "view").select("event_id")


@query(
    f"""WITH {SIGNAL}, b AS (SELECT event_id AS box_id, bag, frame_idx, d AS x_lo, d + 20 AS x_hi, theta::DOUBLE AS y_lo, theta + 40.0 AS y_hi FROM signal)
SELECT a.bag, a.frame_idx, a.box_id, count(DISTINCT a.frame_idx - p.frame_idx) AS lags_met FROM b a JOIN b p ON a.bag = p.bag AND p.frame_idx BETWEEN a.frame_idx - 3 AND a.frame_idx - 1
WHERE p.x_lo - 10 <= a.x_hi + 10 AND p.x_hi + 10 >= a.x_lo - 10 AND p.y_lo - 10 <= a.y_hi + 10 AND p.y_hi + 10 >= a.y_lo - 10 GROUP BY ALL"""
)
def bbox_persistence(spark, sf_dir):
    b = signal(spark, sf_dir).select(F.col("event_id").alias("box_id"), "bag", "frame_idx", F.col("d").alias("x_lo"), (F.col("d") + 20).alias("x_hi"), F.col("theta").cast("double").alias("y_lo"), (F.col("theta") + 40.0).alias("y_hi"))
    return m.overlapping_before(b, ["bag"], "frame_idx", 3, 10.0, 50.0)


MODEL = "model AS (SELECT i AS d_idx, -4.0 + i * 0.05 AS x_left, 4.0 - i * 0.05 AS x_right, -3.0 + i * 0.02 AS z_floor, 3.5 AS z_ceil FROM range(0, 20) r(i))"


@query(
    f"""WITH {POINTS}, {MODEL}, j AS (SELECT p.*, m.d_idx AS i, concat_ws(' + ', CASE WHEN lat < 0 AND abs(lat - x_left) < 0.9 THEN 'left' END, CASE WHEN lat > 0 AND abs(lat - x_right) < 0.9 THEN 'right' END, CASE WHEN abs(ver - z_floor) < 0.9 THEN 'floor' END, CASE WHEN abs(ver - z_ceil) < 0.9 THEN 'ceiling' END) AS s
FROM points p LEFT JOIN model m ON least(19, greatest(0, floor((p.f - 6) / 2))) = m.d_idx) SELECT bag, CASE WHEN i IS NOT NULL THEN CASE WHEN s = '' THEN 'other' ELSE s END END AS surface, count(*) AS n FROM j GROUP BY ALL"""
)
def surface_classify(spark, sf_dir):
    i = F.col("id")
    model = spark.range(20).select(i.alias("d_idx"), (i * 0.05 - 4.0).alias("x_left"), (4.0 - i * 0.05).alias("x_right"), (i * 0.02 - 3.0).alias("z_floor"), F.lit(3.5).alias("z_ceil"))
    return m.surface_of(points(spark, sf_dir), model, 2.0, 0.9, 6.0).groupBy("bag", "surface").agg(F.count("*").alias("n"))


@query(f"WITH {SIGNAL} SELECT event_id, CASE WHEN fam IN ('click', 'view') THEN d WHEN fam = 'error' THEN theta::DOUBLE END AS d, CASE WHEN fam IN ('click', 'view') THEN 'map' WHEN fam = 'error' THEN 'model' END AS source FROM signal")
def map_then_model_fallback(spark, sf_dir):
    e = signal(spark, sf_dir)
    return m.fallback(e.select("event_id"), e.where("fam IN ('click', 'view')"), e.where("fam IN ('error', 'click')").select("event_id", F.col("theta").cast("double").alias("d")), ["event_id"], "d")


@query(
    f"""WITH {SIGNAL}, c AS (SELECT bag, frame_idx // 4 AS grp, event_id, abs(theta - 120) / 10.0 AS le, abs(theta - 240) / 10.0 AS re FROM signal), l AS (SELECT bag, grp, arg_min(event_id, struct_pack(e := le, n := event_id)) AS n, min(le) AS e FROM c GROUP BY ALL),
r AS (SELECT c.bag, c.grp, arg_min(c.event_id, struct_pack(e := re, n := c.event_id)) AS n, min(re) AS e FROM c JOIN l ON c.bag = l.bag AND c.grp = l.grp AND c.event_id <> l.n GROUP BY ALL)
SELECT l.bag, l.grp, CASE WHEN l.e < 10 THEN l.n END AS left_of, CASE WHEN r.e < 10 THEN r.n END AS right_of FROM l LEFT JOIN r ON l.bag = r.bag AND l.grp = r.grp"""
)
def fan_assignment(spark, sf_dir):
    c = signal(spark, sf_dir).select("bag", F.floor(F.col("frame_idx") / 4).alias("grp"), "event_id", (F.abs(F.col("theta") - 120) / 10.0).alias("le"), (F.abs(F.col("theta") - 240) / 10.0).alias("re"))
    return m.assign_fans(c, ["bag", "grp"], "event_id", "le", "re")


@query(f"WITH {CELLS} , r AS (SELECT bag, frame_idx, iu, iv, f_min, row_number() OVER (PARTITION BY bag, frame_idx ORDER BY f_min DESC, iu DESC, iv DESC) AS rank FROM states) SELECT *, FROM r WHERE rank <= 6")
def topk_cells(spark, sf_dir):
    return m.ranked(states(spark, sf_dir).drop("st"), ["bag", "frame_idx"], [F.desc("f_min"), F.desc("iu"), F.desc("iv")], 6).select("bag", "frame_idx", "iu", "iv", "f_min", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {POINTS} SELECT bag, frame_idx, count(*) AS n FROM points GROUP BY ALL ORDER BY n DESC, bag, frame_idx LIMIT 10")
def busiest_frames(spark, sf_dir):
    return points(spark, sf_dir).groupBy("bag", "frame_idx").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bag", "frame_idx").limit(10)


@query(f"WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY bag) AS n FROM signal) SELECT event_id, bag, frame_idx FROM n WHERE frame_idx % greatest(1, n // 100) = 0")
def stride_decimation(spark, sf_dir):
    return s.stride_sample(signal(spark, sf_dir), ["bag"], "frame_idx", 100).select("event_id", "bag", "frame_idx")


@query(f"WITH {SIGNAL} SELECT event_id FROM signal WHERE frame_idx % 5 = 0")
def frame_sampling(spark, sf_dir):
    return s.every(signal(spark, sf_dir), "frame_idx", 5).select("event_id")


@query(f"WITH {SIGNAL}, k AS (SELECT bag, event_id, row_number() OVER (PARTITION BY bag ORDER BY md5(event_id || ':7'), event_id) AS k FROM signal) SELECT bag, event_id FROM k WHERE k <= 50")
def seeded_cap(spark, sf_dir):
    """A random sample of 50 points of each bag, the same for the same seed. The cap is the operator."""
    return s.seeded_cap(signal(spark, sf_dir), ["bag"], "event_id", 50, 7).select("bag", "event_id")


@query(f"WITH {CELLS} SELECT DISTINCT frame_idx, iu, iv FROM states WHERE st = 1")
def mask_union(spark, sf_dir):
    """Cells lit in any bag, by frame."""
    lit = states(spark, sf_dir).where("st = 1")
    return s.union_cells(*(lit.where(F.col("bag") == b) for b in range(4)), keys=["frame_idx"])


@query(f"WITH {CELLS} SELECT bag, frame_idx, iu, iv FROM states a WHERE st = 1 AND NOT EXISTS (SELECT 1 FROM states b WHERE b.bag = (a.bag + 1) % 4 AND b.st = 1 AND a.frame_idx = b.frame_idx AND a.iu = b.iu AND a.iv = b.iv)")
def mask_difference(spark, sf_dir):
    """Lit cells of each bag that the next bag, and the first after the last, has not."""
    lit = states(spark, sf_dir).where("st = 1")
    return s.cell_difference(lit, lit.withColumn("bag", (F.col("bag") + 3) % 4), ["bag", "frame_idx"])


@query(f"WITH {CELLS} SELECT DISTINCT bag, frame_idx, iu + a AS iu, iv + b AS iv FROM states, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE st = 1")
def dilate3(spark, sf_dir):
    return w.dilated(states(spark, sf_dir).where("st = 1"), ["bag", "frame_idx"])


@query(f"WITH {CELLS} SELECT DISTINCT bag, frame_idx, iu + a AS iu, iv + b AS iv FROM states, range(-4, 5) x(a), range(-4, 5) y(b) WHERE st = 2 AND abs(a) + abs(b) <= 4")
def dilate_l1(spark, sf_dir):
    return w.dilated(states(spark, sf_dir).where("st = 2"), ["bag", "frame_idx"], 4, cross=True).select("bag", "frame_idx", F.col("iu").cast("long").alias("iu"), F.col("iv").cast("long").alias("iv"))


@query(f"WITH {CELLS}, c AS (SELECT bag, iu, iv, count(*) AS n FROM cells GROUP BY ALL) SELECT bag, iu + a AS iu, iv + b AS iv, sum(n)::BIGINT AS n FROM c, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) GROUP BY ALL")
def box_sum3(spark, sf_dir):
    from .grid_queries import cells

    return s.box_sum(cells(spark, sf_dir).groupBy("bag", "iu", "iv").agg(F.count("*").alias("n")), ["bag"], "n", 1)


@query(f"WITH {CELLS}, b AS (SELECT frame_idx, (iu // 4)::BIGINT AS d_idx, (iv // 4)::BIGINT AS theta_idx, count(*) AS n FROM states WHERE st = 1 GROUP BY ALL) SELECT frame_idx, d_idx, theta_idx, n FROM b WHERE NOT (d_idx = 2 AND theta_idx = 2)")
def junk_removed(spark, sf_dir):
    b = states(spark, sf_dir).where("st = 1").groupBy("frame_idx", F.floor(F.col("iu") / 4).alias("d_idx"), F.floor(F.col("iv") / 4).alias("theta_idx")).agg(F.count("*").alias("n"))
    mask = spark.range(1).select(F.lit(2).cast("long").alias("d_idx"), F.lit(2).cast("long").alias("theta_idx"))
    return m.junk_removed(b, mask)


@query("SELECT event_type AS topic, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY ALL")
def topic_counts(spark, sf_dir):
    return s.topics(table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("frame_idx")))


@query("WITH t AS (SELECT event_type AS topic, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT arg_max(topic, struct_pack(n := n, f := -f)) AS most_frequent, arg_min(topic, f) AS first_topic FROM t")
def most_frequent_topic(spark, sf_dir):
    t = s.topics(table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("frame_idx")))
    return s.chosen_topics(t)


@query("SELECT o_orderpriority AS scenario, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'all', o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'")
def union_of_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return s.union_runs([o.select(F.col("o_orderpriority").alias("scenario"), "o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'P'").select(F.lit("all").alias("scenario"), "o_orderkey")])


@query(f"WITH {POINTS} SELECT bag, frame_idx, count(*) AS n FROM points WHERE f > 0.3 AND abs(lat) < 100 AND abs(ver) < 50 AND NOT (f = 0 AND lat = 0 AND ver = 0) GROUP BY ALL")
def valid_points(spark, sf_dir):
    p = points(spark, sf_dir).select("bag", "frame_idx", F.col("lat").alias("x"), (-F.col("f")).alias("y"), F.col("ver").alias("z"))
    return p.where(s.valid_cloud()).where("-y > 0.3").groupBy("bag", "frame_idx").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT bag, frame_idx, count(*) AS n FROM points WHERE NOT (lat = 0 AND ver = 0 AND coalesce(CASE WHEN f >= 5 THEN f % 2 END, -1) = 0) GROUP BY ALL")
def returned_points(spark, sf_dir):
    """Points that are no empty returns; one whose attribute is missing is a return."""
    p = points(spark, sf_dir).select("bag", "frame_idx", F.col("lat").alias("x"), F.col("ver").alias("y"), F.when(F.col("f") >= 5, F.col("f") % 2).alias("s"))
    return p.where(s.returned()).groupBy("bag", "frame_idx").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT bag, frame_idx, count(*) AS n FROM points WHERE sqrt(lat * lat + ver * ver) > 2.5 GROUP BY ALL")
def points_off_sensor(spark, sf_dir):
    """Points farther than 2.5 from the sensor's axis."""
    p = points(spark, sf_dir).select("bag", "frame_idx", F.col("lat").alias("x"), F.col("ver").alias("y"), F.col("f").alias("z"))
    return p.where(s.away_from_sensor(2.5)).groupBy("bag", "frame_idx").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, s AS (SELECT bag, frame_idx FROM points GROUP BY ALL HAVING avg((f < 47 AND abs(lat) < 5.5)::INT) >= 0.9) SELECT bag, frame_idx, count(*) AS n FROM points JOIN s USING (bag, frame_idx) GROUP BY ALL")
def mostly_valid_frames(spark, sf_dir):
    return s.frames_mostly(points(spark, sf_dir), ["bag", "frame_idx"], (F.col("f") < 47) & (F.abs("lat") < 5.5), 0.9).groupBy("bag", "frame_idx").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, c AS (SELECT bag, frame_idx, quantile_cont(lat, 0.5) AS xc FROM points GROUP BY ALL) SELECT bag, frame_idx, trunc(f / 2)::INT AS chunk, count(*) AS n FROM points JOIN c USING (bag, frame_idx) WHERE abs(lat - xc) <= 1.5 AND ver >= -1 AND ver <= 1.1 GROUP BY ALL")
def chunk_rectangle(spark, sf_dir):
    p = points(spark, sf_dir)
    centre = p.groupBy("bag", "frame_idx").agg(F.percentile("lat", 0.5).alias("xc"))
    return s.in_rectangle(p, centre, ["bag", "frame_idx"], 3.0, -1.0, 1.1).groupBy("bag", "frame_idx", (F.col("f") / 2).cast("int").alias("chunk")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SIGNAL}, b AS (SELECT event_id, d / 10 AS f, theta / 40.0 - 4.5 AS y, 0.5 AS z FROM signal),
t AS (SELECT *, greatest(least(20.0 / f, 22.0 / f), CASE WHEN y = 0 THEN -1e30 ELSE least(-1.0 / y, 1.0 / y) END, least(-1.0 / z, 1.0 / z)) AS t0, least(greatest(20.0 / f, 22.0 / f), CASE WHEN y = 0 THEN 1e30 ELSE greatest(-1.0 / y, 1.0 / y) END, greatest(-1.0 / z, 1.0 / z)) AS t1 FROM b)
SELECT event_id FROM t WHERE t0 <= t1 AND t1 >= 0 AND t0 <= 0.999999"""
)
def hidden_by_box(spark, sf_dir):
    b = signal(spark, sf_dir).select("event_id", (F.col("d") / 10).alias("f"), (F.col("theta") / 40.0 - 4.5).alias("y"), F.lit(0.5).alias("z"))
    return b.where(s.crosses_box([F.col("f"), F.col("y"), F.col("z")], (20.0, -1.0, -1.0), (22.0, 1.0, 1.0))).select("event_id")
