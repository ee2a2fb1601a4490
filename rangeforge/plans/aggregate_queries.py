"""Queries of the robust and weighted aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import grids
from ..sources.driver import POINTS, PROFILES, SIGNAL, points, profiles, signal, table
from .grid_queries import CELLS, states
from .registry import query


@query(
    f"""WITH {POINTS}, long AS (SELECT 'f' AS axis, 0 AS place, f AS x FROM points UNION ALL SELECT 'lat', 1, lat FROM points UNION ALL SELECT 'ver', 2, ver FROM points),
s AS (SELECT axis, place, quantile_cont(x, 0.99) AS hi, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.5) AS med FROM long GROUP BY ALL),
r AS (SELECT axis, place, hi - lo AS span, med, abs((hi + lo) / 2) AS off, row_number() OVER (ORDER BY hi - lo DESC, place) AS k FROM s),
p AS (SELECT a.axis AS fwd, a.med, b.axis AS b, c.axis AS c, b.span - c.span <= 0.2 * b.span AND CASE WHEN c.place < b.place THEN c.off < b.off ELSE c.off <= b.off END AS swap FROM r a, r b, r c WHERE a.k = 1 AND b.k = 2 AND c.k = 3)
SELECT fwd AS forward, CASE WHEN med < 0 THEN -1 ELSE 1 END AS sign, CASE WHEN swap THEN c ELSE b END AS lateral, CASE WHEN swap THEN b ELSE c END AS vertical FROM p"""
)
def axis_detect(spark, sf_dir):
    return a.detect_axes(points(spark, sf_dir), ["f", "lat", "ver"])


@query(
    f"""WITH {SIGNAL}, o AS (SELECT bag, floor(d)::INT AS level, row_number() OVER (PARTITION BY bag ORDER BY floor(d)) - 1 AS i, count(*) OVER (PARTITION BY bag) AS n FROM signal)
SELECT bag, greatest(25.0, 0.5 * (max(level) FILTER (i = floor(n * 0.3)::BIGINT) + max(level) FILTER (i = floor(n * 0.8)::BIGINT))) AS threshold FROM o GROUP BY ALL"""
)
def order_stat_threshold(spark, sf_dir):
    return a.order_statistic_threshold(signal(spark, sf_dir).withColumn("level", F.floor("d").cast("int")), ["bag"], "level")


@query(f"WITH {SIGNAL} SELECT bag, round(greatest(200.0, quantile_cont(d, 0.99) - 25), 6) AS threshold FROM signal WHERE frame_idx % 4 = 0 AND theta % 4 = 0 GROUP BY ALL")
def bright_threshold(spark, sf_dir):
    return a.bright_threshold(signal(spark, sf_dir), ["bag"], "frame_idx", "theta", "d").select("bag", F.round("threshold", 6).alias("threshold"))


@query(
    f"""WITH {POINTS}, r AS (SELECT bag, frame_idx, f AS d, sum(intensity) / 1000 AS score FROM points GROUP BY ALL),
b AS (SELECT bag, frame_idx, max(score) AS peak, arg_min(d, struct_pack(s := -score, d := d)) AS peak_d FROM r GROUP BY ALL HAVING max(score) >= 150)
SELECT bag, frame_idx, peak_d, round(sum(d * score) / sum(score), 6) AS wall FROM r JOIN b USING (bag, frame_idx) WHERE abs(d - peak_d) <= 5 AND score >= 0.4 * peak GROUP BY ALL"""
)
def weighted_wall(spark, sf_dir):
    rows = points(spark, sf_dir).groupBy("bag", "frame_idx", F.col("f").alias("d")).agg((F.sum("intensity") / 1000).alias("score"))
    return a.weighted_peak(rows, ["bag", "frame_idx"], "d", "score", 150.0, 5.0).withColumn("wall", F.round("wall", 6))


@query(f"WITH {SIGNAL}, m AS (SELECT bag, fam, degrees(atan2(sum(d * sin(radians(theta))), sum(d * cos(radians(theta))))) AS t FROM signal GROUP BY ALL) SELECT bag, fam, round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 4) AS theta FROM m")
def circular_mean(spark, sf_dir):
    return signal(spark, sf_dir).groupBy("bag", "fam").agg(F.round(a.circular_mean(F.col("theta").cast("double"), F.col("d")), 4).alias("theta"))


@query(f"WITH {SIGNAL}, r AS (SELECT bag, fam, d, row_number() OVER (PARTITION BY bag, fam ORDER BY d, event_id) AS k FROM signal) SELECT bag, fam, round(quantile_cont(d, 0.5), 6) AS d_median, count(*) AS used FROM r WHERE k <= 20 GROUP BY ALL")
def nearest_k_median(spark, sf_dir):
    return a.nearest_k_median(signal(spark, sf_dir), ["bag", "fam"], "d", "event_id").withColumn("d_median", F.round("d_median", 6))


@query(
    f"""WITH {SIGNAL}, p AS (SELECT bag, frame_idx // 10 AS grp, fam, min(d) AS d FROM signal GROUP BY ALL), s AS (SELECT bag, grp, list_sort(list(d)) AS s FROM p GROUP BY ALL)
SELECT bag, grp, len(s)::INT AS fans, CASE WHEN len(s) >= 2 AND s[1] / s[len(s) // 2 + 1] <= 0.75 THEN s[1] ELSE (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2 END AS closest FROM s"""
)
def closest_rule(spark, sf_dir):
    s = signal(spark, sf_dir).withColumn("grp", F.floor(F.col("frame_idx") / 10))
    return a.closest_rule(s, ["bag", "grp"], "fam", "d")


@query(f"WITH {SIGNAL} SELECT fam, count(*) AS n, round(sqrt(avg((d - theta) * (d - theta))), 6) AS rms, round(max(abs(d - theta)), 6) AS max_abs, round(avg(d - theta), 6) AS bias FROM signal GROUP BY ALL")
def error_report(spark, sf_dir):
    e = a.error_report(signal(spark, sf_dir), ["fam"], "d", "theta")
    return e.select("fam", "n", *[F.round(c, 6).alias(c) for c in ("rms", "max_abs", "bias")])


@query(f"WITH {POINTS} SELECT bag, count(*) AS n, round(quantile_cont(intensity, 0.02), 4) AS p2, round(quantile_cont(intensity, 0.5), 4) AS p50, round(quantile_cont(intensity, 0.98), 4) AS p98 FROM points GROUP BY ALL")
def channel_percentiles(spark, sf_dir):
    p = a.channel_percentiles(points(spark, sf_dir), "bag", "intensity", [0.02, 0.5, 0.98])
    return p.select("bag", "n", *[F.round(c, 4).alias(c) for c in ("p2", "p50", "p98")])


@query(f"WITH {POINTS} SELECT f AS value, count(*) AS n FROM points GROUP BY ALL ORDER BY n DESC, value LIMIT 8")
def value_frequencies(spark, sf_dir):
    return a.value_frequencies(points(spark, sf_dir), F.col("f"), 8)


@query(
    f"""WITH {SIGNAL}, s AS (SELECT bag, count(*) AS n, min(d) AS d_min, max(d) AS d_max, round(quantile_cont(d, 0.5), 6) AS d_median, round(quantile_cont(d, 0.98), 6) AS d_p98,
(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS seconds FROM signal GROUP BY ALL)
SELECT * REPLACE (round(seconds, 3) AS seconds), CASE WHEN seconds > 0 THEN round(least(30.0, greatest(1.0, (n - 1) / seconds)), 6) ELSE 1.0 END AS fps FROM s"""
)
def frame_stats(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    s = a.frame_stats(signal(spark, sf_dir), ["bag"], "d", seconds)
    return s.select("bag", "n", "d_min", "d_max", F.round("d_median", 6).alias("d_median"), F.round("d_p98", 6).alias("d_p98"), F.round("seconds", 3).alias("seconds"), F.round("fps", 6).alias("fps"))


@query(f"WITH {POINTS} SELECT bag, round(avg((f < 14)::INT), 6) AS low_share, round(avg((f >= 45)::INT), 6) AS high_share FROM points GROUP BY ALL")
def corridor_share(spark, sf_dir):
    s = a.corridor_share(points(spark, sf_dir), ["bag"], "f", 14.0, 45.0)
    return s.select("bag", F.round("low_share", 6).alias("low_share"), F.round("high_share", 6).alias("high_share"))


@query(
    f"""WITH {CELLS}, c AS (SELECT bag, frame_idx, sum((st = 1)::INT)::BIGINT AS lit_px, sum((st = 2)::INT)::BIGINT AS occluded_px FROM states GROUP BY ALL)
SELECT bag, count(*) AS frames, min(lit_px) AS lit_px_min, max(lit_px) AS lit_px_max, round(avg(lit_px), 6) AS lit_px_mean, arg_max(frame_idx, struct_pack(c := lit_px, f := -frame_idx)) AS lit_px_argmax,
min(occluded_px) AS occluded_px_min, max(occluded_px) AS occluded_px_max, round(avg(occluded_px), 6) AS occluded_px_mean, arg_max(frame_idx, struct_pack(c := occluded_px, f := -frame_idx)) AS occluded_px_argmax FROM c GROUP BY ALL"""
)
def shadowgram_summary(spark, sf_dir):
    s = a.sequence_summary(grids.state_counts(states(spark, sf_dir), ["bag", "frame_idx"]), ["bag"], "frame_idx", ["lit_px", "occluded_px"])
    return s.withColumns({c: F.round(c, 6) for c in ("lit_px_mean", "occluded_px_mean")})


@query(f"WITH {POINTS}, c AS (SELECT bag, frame_idx, sum((abs(lat * 30 / f) >= 5)::INT)::BIGINT AS clipped FROM points GROUP BY ALL) SELECT *, max(clipped) OVER (PARTITION BY bag ORDER BY frame_idx) AS worst FROM c")
def clipped_running(spark, sf_dir):
    return a.clipped_running(points(spark, sf_dir), "bag", "frame_idx", F.abs(F.col("lat") * 30 / F.col("f")) >= 5)


@query(f"WITH {POINTS} SELECT frame_idx, " + ", ".join(f"max(intensity) FILTER (trunc(f / 10) = {k}) AS c{k}" for k in range(5)) + " FROM points GROUP BY ALL")
def chunk_max_grid(spark, sf_dir):
    return a.max_grid(points(spark, sf_dir).withColumn("chunk", (F.col("f") / 10).cast("int")), "frame_idx", "chunk", "intensity", list(range(5)))


@query(
    """WITH r AS (SELECT o_orderpriority AS scenario, o_orderkey, o_orderstatus = 'F' AS stable, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT scenario, count(*) AS objects, sum(stable::INT)::BIGINT AS stable, string_agg(CASE WHEN k <= 5 THEN o_orderkey::VARCHAR END, ',' ORDER BY k) AS largest FROM r GROUP BY ALL"""
)
def scenario_digest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "scenario")
    return a.scenario_digest(orders, "scenario", F.col("o_orderstatus") == "F", "o_totalprice", "o_orderkey")


@query(f"WITH {PROFILES}, p AS (SELECT vec_id, bin, greatest(v, 0) AS v FROM profiles), m AS (SELECT vec_id, quantile_cont(v, 0.5) AS m FROM p GROUP BY ALL) SELECT vec_id, bin, round(v / CASE WHEN m = 0 THEN 1 ELSE m END, 4) AS strength FROM p JOIN m USING (vec_id)")
def row_median_norm(spark, sf_dir):
    p = profiles(spark, sf_dir).select("vec_id", "bin", F.greatest("v", F.lit(0.0)).alias("v"))
    return a.row_median_norm(p, ["vec_id"], "v").select("vec_id", "bin", F.round("strength", 4).alias("strength"))
