"""Queries of the histogram, z-buffer and extent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Grid
from ..operators import grids
from ..sources.driver import POINTS, PROFILES, SIGNAL, points, profiles, signal
from .registry import query

PLANE = Grid()
D0 = 30.0
SCREENS = [10.0, 20.0, 30.0, 40.0]
KEYS = ["bag", "frame_idx"]
#: Cells of the decision plane in SQL.
CELLS = (
    POINTS
    + """, uv AS (SELECT *, lat * 30.0 / f AS u, ver * 30.0 / f AS v FROM points WHERE f > 0.3),
cells AS (SELECT *, trunc((u + 5.0) / 0.5 + 1e-6)::INT AS iu, trunc((v + 4.0) / 0.5 + 1e-6)::INT AS iv FROM uv WHERE u >= -5 AND u < 5 AND v >= -4 AND v < 4),
states AS (SELECT bag, frame_idx, iu, iv, min(f) AS f_min, CASE WHEN min(f) > 30 THEN 1 ELSE 2 END AS st FROM cells GROUP BY ALL)"""
)


def cells(spark, sf_dir):
    return grids.plane_cells(points(spark, sf_dir), D0, PLANE)


def states(spark, sf_dir):
    return grids.z_buffer(cells(spark, sf_dir), KEYS, D0)


@query(f"WITH {CELLS} SELECT bag, frame_idx, sum((st = 1)::INT)::BIGINT AS lit_px, sum((st = 2)::INT)::BIGINT AS occluded_px FROM states GROUP BY ALL")
def plane_state_counts(spark, sf_dir):
    return grids.state_counts(states(spark, sf_dir), KEYS)


@query(f"WITH {CELLS} SELECT bag, frame_idx, iu, iv, f_min, st FROM states")
def plane_states(spark, sf_dir):
    return states(spark, sf_dir)


@query(
    f"""WITH {POINTS}, many AS (SELECT D, lat * D / f AS u, ver * D / f AS v FROM points, (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0)) s(D) WHERE f > D + 5)
SELECT D, trunc((u + 5.0) / 0.5 + 1e-6)::INT AS iu, trunc((v + 4.0) / 0.5 + 1e-6)::INT AS iv, count(*) AS n FROM many
WHERE u >= -5 AND u < 5 AND v >= -4 AND v < 4 GROUP BY ALL"""
)
def screen_histogram(spark, sf_dir):
    return grids.screen_histogram(points(spark, sf_dir), SCREENS, 5.0, PLANE)


@query(
    f"""WITH {POINTS}, ab AS (SELECT lat / f AS a, ver / f AS b, f FROM points WHERE f > 0)
SELECT threshold, trunc((a + 0.5) / 0.02 + 1e-6)::INT AS ia, trunc((b + 0.4) / 0.02 + 1e-6)::INT AS ib, count(*) AS n
FROM ab, (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0)) s(threshold) WHERE f > threshold AND a >= -0.5 AND a < 0.5 AND b >= -0.4 AND b < 0.4 GROUP BY ALL"""
)
def angular_screens(spark, sf_dir):
    return grids.angular_screens(points(spark, sf_dir), SCREENS, 0.02, Grid(-0.5, 0.5, -0.4, 0.4))


@query(
    f"""WITH {POINTS}, many AS (SELECT f, lat, unnest(range(0, least(floor(f / 2.0), 25)::INT + 1))::INT AS "row" FROM points WHERE f > 0),
u AS (SELECT "row", lat * ("row" * 2.0::DOUBLE) / f AS u FROM many)
SELECT "row", trunc((u + 4.0) / 0.25 + 1e-6)::INT AS iu, count(*) AS n FROM u WHERE u >= -4 AND u < 4 GROUP BY ALL"""
)
def proj_rows(spark, sf_dir):
    return grids.projection_rows(points(spark, sf_dir), 2.0, 50.0, 4.0, 0.25)


@query(
    f"""WITH {POINTS} SELECT bag, trunc(f / 2.0)::INT AS d_bin, trunc((lat + 3.5) / 0.1)::INT AS y_bin, count(*) AS n
FROM points WHERE f >= 0 AND f < 180 AND abs(lat) < 3.5 GROUP BY ALL"""
)
def occupancy_grid(spark, sf_dir):
    return grids.occupancy(points(spark, sf_dir), 2.0, 0.1, 180.0, 3.5, ["bag"])


@query(
    f"""WITH {POINTS}, s AS (SELECT *, unnest(range(greatest(0, ceil((frame_idx - 4) / 2.0))::BIGINT, (frame_idx // 2) + 1)) AS stack FROM points),
m AS (SELECT * FROM s, (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0)) d(D) WHERE f >= D - 2 AND f <= D)
SELECT bag, stack, D, trunc((lat + 6.0) / 0.5 + 1e-6)::INT AS bin, count(*) AS n FROM m GROUP BY ALL"""
)
def lateral_profile(spark, sf_dir):
    return grids.lateral_profile(grids.stacked(points(spark, sf_dir), 5, 2), SCREENS, 2.0, -6.0, 0.5, ["bag", "stack"])


@query(
    f"""WITH {POINTS}, m AS (SELECT * FROM points, (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0)) d(D) WHERE f >= D - 2 AND f <= D),
p AS (SELECT bag, frame_idx, D, trunc((lat + 6.0) / 0.5 + 1e-6)::INT AS bin, count(*) AS n FROM m GROUP BY ALL)
SELECT bag, frame_idx, D, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins FROM p GROUP BY ALL HAVING count(*) >= 5"""
)
def profile_edges(spark, sf_dir):
    profile = grids.lateral_profile(points(spark, sf_dir), SCREENS, 2.0, -6.0, 0.5, KEYS)
    return grids.profile_edges(profile, [*KEYS, "D"])


@query(
    f"""WITH {POINTS}, m AS (SELECT * FROM points, (VALUES (10.0::DOUBLE), (20.0), (30.0), (40.0)) d(D) WHERE f >= D - 2 AND f <= D)
SELECT D, round_even(intensity / 1000.0, 0)::BIGINT AS s, lat::INT AS y, count(*) AS n FROM m GROUP BY ALL"""
)
def attribute_section(spark, sf_dir):
    return grids.attribute_section(points(spark, sf_dir), SCREENS, 2.0, 1000.0)


@query(
    f"""WITH {POINTS}, c AS (SELECT bag, frame_idx, trunc(f / 5.0 + 1e-6)::INT AS i_f, floor(lat / 5.0)::INT AS i_lat, count(*) AS n FROM points GROUP BY ALL)
SELECT bag, frame_idx, i_f, i_lat, n, sum(n) OVER (PARTITION BY bag, i_f, i_lat ORDER BY frame_idx)::BIGINT AS running FROM c"""
)
def topdown_running(spark, sf_dir):
    return grids.topdown_running(points(spark, sf_dir), 5.0)


@query(
    f"""WITH {SIGNAL}, p AS (SELECT bag, theta // 10 AS col, arg_min(struct_pack(d := d, fam := fam, frame_idx := frame_idx), struct_pack(d := d, event_id := event_id)) AS b FROM signal GROUP BY ALL)
SELECT bag, col, b.d AS d, b.fam AS fam, b.frame_idx AS frame_idx FROM p"""
)
def nearest_wins(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("col", F.floor(F.col("theta") / 10))
    return grids.nearest_wins(s, ["bag", "col"], "d", "event_id", ["fam", "frame_idx"])


@query(f"WITH {CELLS} SELECT iu, iv, count(DISTINCT frame_idx) AS images FROM states WHERE st = 1 GROUP BY ALL HAVING count(DISTINCT frame_idx) >= 3")
def static_cells(spark, sf_dir):
    return grids.static_cells(states(spark, sf_dir).where(F.col("st") == grids.LIT), "frame_idx", 3)


@query(
    f"""WITH {POINTS}, uv AS (SELECT lat * 30.0 / f AS u, ver * 30.0 / f AS v, f > 30 AS far FROM points WHERE f > 0.3),
n AS (SELECT count(*) FILTER (far) AS n_far FROM uv),
k AS (SELECT uv.* FROM uv, n WHERE far OR n_far < 50)
SELECT round(quantile_cont(u, 0.01) - 0.5, 6) AS u_lo, round(quantile_cont(u, 0.99) + 0.5, 6) AS u_hi, round(quantile_cont(v, 0.01) - 0.5, 6) AS v_lo,
round(quantile_cont(v, 0.99) + 0.5, 6) AS v_hi, any_value(n_far) AS n_far FROM k, n"""
)
def auto_grid_extent(spark, sf_dir):
    e = grids.extent(points(spark, sf_dir), D0, 0.5)
    return e.select(*[F.round(c, 6).alias(c) for c in ("u_lo", "u_hi", "v_lo", "v_hi")], "n_far")


@query(
    f"""WITH {PROFILES}, b AS (SELECT vec_id, floor((v + 4.0) / 0.25)::INT AS level FROM profiles WHERE v >= -4 AND v < 4)
SELECT level, count(*) AS n, count(DISTINCT vec_id) AS vectors FROM b GROUP BY ALL"""
)
def strength_histogram(spark, sf_dir):
    p = profiles(spark, sf_dir).where((F.col("v") >= -4) & (F.col("v") < 4))
    return p.groupBy(F.floor((F.col("v") + 4.0) / 0.25).cast("int").alias("level")).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("vectors"))
