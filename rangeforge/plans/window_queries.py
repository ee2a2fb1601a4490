"""Queries of the frame-ordered operators: consensus, smoothing, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.driver import POINTS, PROFILES, SIGNAL, points, profiles, signal
from .grid_queries import CELLS, states
from .registry import query

FRAMES = "frames AS (SELECT bag, frame_idx, row_number() OVER (PARTITION BY bag ORDER BY frame_idx) AS seq FROM (SELECT DISTINCT bag, frame_idx FROM states))"


def _sliding(start: int) -> str:
    """Consensus of five frames by a plain join of windows with lit cells."""
    return f"""WITH {CELLS}, {FRAMES}, lit AS (SELECT s.bag, seq, iu, iv FROM states s JOIN frames USING (bag, frame_idx) WHERE st = 1)
SELECT f.bag, f.frame_idx, iu, iv, count(*) / 5.0::DOUBLE AS share FROM frames f JOIN lit l ON f.bag = l.bag AND l.seq BETWEEN f.seq - {4 + start} AND f.seq - {start}
WHERE f.seq >= {5 + start} GROUP BY ALL HAVING count(*) / 5.0 > 0.5"""


@query(f"WITH {CELLS}, n AS (SELECT bag, count(DISTINCT frame_idx) AS frames FROM states GROUP BY ALL) SELECT bag, iu, iv, count(*) AS lit, frames, count(*) / frames::DOUBLE AS share FROM states JOIN n USING (bag) WHERE st = 1 GROUP BY bag, iu, iv, frames HAVING count(*) / frames::DOUBLE > 0.1")
def global_consensus(spark, sf_dir):
    return w.global_consensus(states(spark, sf_dir), ["bag"], 0.1)


@query(_sliding(0))
def sliding_consensus_incl(spark, sf_dir):
    return w.sliding_consensus(states(spark, sf_dir), "bag", 5, 0.5, current=True)


@query(_sliding(1))
def sliding_consensus_excl(spark, sf_dir):
    return w.sliding_consensus(states(spark, sf_dir), "bag", 5, 0.5, current=False)


@query(
    f"""WITH ref AS ({_sliding(1)}), {CELLS.replace('points AS', 'points AS', 1)}, {FRAMES}, fullf AS (SELECT bag, frame_idx FROM frames WHERE seq >= 6),
st AS (SELECT s.* FROM states s JOIN fullf USING (bag, frame_idx))
SELECT coalesce(st.bag, ref.bag) AS bag, coalesce(st.frame_idx, ref.frame_idx) AS frame_idx, coalesce(st.iu, ref.iu) AS iu, coalesce(st.iv, ref.iv) AS iv,
CASE WHEN ref.iu IS NOT NULL THEN 'shadow' ELSE 'object' END AS kind FROM st FULL JOIN ref ON st.bag = ref.bag AND st.frame_idx = ref.frame_idx AND st.iu = ref.iu AND st.iv = ref.iv
WHERE (ref.iu IS NOT NULL AND coalesce(st.st, 0) <> 1) OR (ref.iu IS NULL AND st.st = 1)"""
)
def shadow_objects(spark, sf_dir):
    s = states(spark, sf_dir)
    reference = w.sliding_consensus(s, "bag", 5, 0.5, current=False)
    frames = s.select("bag", "frame_idx").distinct().withColumn("seq", F.row_number().over(w.Window.partitionBy("bag").orderBy("frame_idx"))).where("seq >= 6")
    return w.shadows_and_objects(s.join(frames.drop("seq"), ["bag", "frame_idx"]), reference, ["bag", "frame_idx"])


DILATED = "dil AS (SELECT DISTINCT bag, frame_idx, iu + a AS iu, iv + b AS iv FROM states, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE st = 1)"


@query(
    f"""WITH {CELLS}, {DILATED}, fst AS (SELECT bag, min(frame_idx) AS first FROM states WHERE st = 1 GROUP BY bag)
SELECT bag, frame_idx, iu, iv FROM dil a JOIN fst USING (bag) WHERE frame_idx >= first + 2 AND (SELECT count(*) FROM dil b WHERE a.bag = b.bag AND a.iu = b.iu AND a.iv = b.iv AND b.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx) = 3
UNION ALL SELECT bag, frame_idx, iu, iv FROM states JOIN fst USING (bag) WHERE st = 1 AND frame_idx < first + 2"""
)
def stable_cells_3(spark, sf_dir):
    return w.stable_cells(states(spark, sf_dir).where("st = 1"), "bag")


@query(
    f"""WITH {SIGNAL}, n AS (SELECT event_id, d, coalesce(lag(d) OVER o, d) AS a, coalesce(lead(d) OVER o, d) AS b FROM signal WINDOW o AS (PARTITION BY bag ORDER BY frame_idx))
SELECT event_id, list_sort([a, d, b])[2] AS smooth FROM n"""
)
def moving_median_3(spark, sf_dir):
    return w.moving_median(signal(spark, sf_dir), ["bag"], "frame_idx", "d").select("event_id", "smooth")


@query(f"WITH {PROFILES} SELECT vec_id, bin, round(greatest(0.0, quantile_cont(v, 0.5) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)), 6) AS background FROM profiles")
def background_median_21(spark, sf_dir):
    return w.background_median(profiles(spark, sf_dir), ["vec_id"], "bin", "v", floor=0.0).select("vec_id", "bin", F.round("background", 6).alias("background"))


@query(
    f"""WITH RECURSIVE {SIGNAL}, s AS (SELECT bag, frame_idx, CASE WHEN fam <> 'error' THEN d END AS x FROM signal),
r AS (SELECT bag, frame_idx, x AS ema, CASE WHEN x IS NULL THEN 1 ELSE 0 END AS misses FROM s WHERE frame_idx = 0
UNION ALL SELECT s.bag, s.frame_idx, CASE WHEN s.x IS NULL THEN CASE WHEN r.misses + 1 > 2 THEN NULL ELSE r.ema END WHEN r.ema IS NULL THEN s.x ELSE 0.7 * r.ema + (1 - 0.7) * s.x END,
CASE WHEN s.x IS NULL THEN r.misses + 1 ELSE 0 END FROM r JOIN s ON s.bag = r.bag AND s.frame_idx = r.frame_idx + 1)
SELECT bag, frame_idx, floor(ema * 1e4 + 0.500001) / 1e4 AS ema FROM r"""
)
def ema_with_reset(spark, sf_dir):
    return w.ema_with_reset(signal(spark, sf_dir), "bag", "frame_idx", "d", F.col("fam") == "error", patience=2).withColumn("ema", F.floor(F.col("ema") * 1e4 + 0.500001) / 1e4)


@query(
    f"""WITH {SIGNAL}, g AS (SELECT bag, frame_idx, frame_idx - row_number() OVER (PARTITION BY bag ORDER BY frame_idx) AS g FROM signal WHERE d < 250)
SELECT bag, min(frame_idx) AS first, max(frame_idx) AS last, count(*) AS length FROM g GROUP BY bag, g HAVING count(*) >= 2"""
)
def dark_runs(spark, sf_dir):
    return w.runs(signal(spark, sf_dir), ["bag"], "frame_idx", F.col("d") < 250).where("length >= 2")


@query(
    f"""WITH {SIGNAL}, t AS (SELECT DISTINCT bag, theta // 4 AS col FROM signal WHERE d < 100), u AS (SELECT bag, col FROM t UNION ALL SELECT bag, col + 90 FROM t),
g AS (SELECT bag, col, col - row_number() OVER (PARTITION BY bag ORDER BY col) AS g FROM u), r AS (SELECT bag, count(*) AS n FROM g GROUP BY bag, g) SELECT bag, least(max(n), 90) AS streak FROM r GROUP BY ALL"""
)
def circular_streak(spark, sf_dir):
    return w.longest_circular_run(signal(spark, sf_dir).where("d < 100").select("bag", F.floor(F.col("theta") / 4).alias("col")).distinct(), ["bag"], "col", 90)


@query(
    f"""WITH {SIGNAL}, n AS (SELECT bag, event_id, d, CASE WHEN d - lag(d) OVER (PARTITION BY bag ORDER BY d) > 0.5 THEN 1 ELSE 0 END AS n FROM signal)
SELECT event_id, sum(n) OVER (PARTITION BY bag ORDER BY d)::BIGINT AS cluster FROM n"""
)
def gap_clusters(spark, sf_dir):
    return w.gap_clusters(signal(spark, sf_dir), ["bag"], "d", 0.5).select("event_id", "cluster")


@query(
    f"""WITH {PROFILES}, b AS (SELECT *, greatest(0.05, quantile_cont(v, 0.5) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS bg FROM profiles),
g AS (SELECT vec_id, bin, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS g FROM b WHERE v / bg >= 0.5) SELECT vec_id, min(bin) AS first, max(bin) AS last, count(*) AS length FROM g GROUP BY vec_id, g HAVING count(*) >= 4"""
)
def long_structures(spark, sf_dir):
    p = w.background_median(profiles(spark, sf_dir), ["vec_id"], "bin", "v", floor=0.05)
    return w.runs(p, ["vec_id"], "bin", F.col("v") / F.col("background") >= 0.5).where("length >= 4")


@query(f"WITH {PROFILES}, s AS (SELECT vec_id, bin FROM profiles WHERE v > -0.12), c AS (SELECT *, count(*) OVER (PARTITION BY vec_id ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS n FROM s) SELECT vec_id, bin FROM c WHERE n = 8")
def erosion_run8(spark, sf_dir):
    return w.eroded_runs(profiles(spark, sf_dir).where("v > -0.12").select("vec_id", "bin"), ["vec_id"], "bin", 8)


@query(
    f"""WITH {PROFILES}, p AS (SELECT vec_id, max(v) AS p, arg_min(bin, struct_pack(s := -v, bin := bin)) AS peak_bin FROM profiles GROUP BY ALL),
g AS (SELECT vec_id, peak_bin, bin, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS g FROM profiles JOIN p USING (vec_id) WHERE v > 0.2 * p),
r AS (SELECT vec_id, peak_bin, min(bin) AS first, max(bin) AS last FROM g GROUP BY vec_id, peak_bin, g) SELECT vec_id, first, last FROM r WHERE first <= peak_bin AND peak_bin <= last"""
)
def peak_band(spark, sf_dir):
    return w.band_around_peak(profiles(spark, sf_dir), ["vec_id"], "bin", "v", 0.2)


@query(
    f"""WITH {PROFILES}, g AS (SELECT vec_id, bin, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS g FROM profiles WHERE v <= 0.05 AND bin > 0),
r AS (SELECT vec_id, min(bin) + 2 AS onset, count(*) AS length FROM g GROUP BY vec_id, g HAVING count(*) >= 3),
t AS (SELECT r.vec_id, onset, length, quantile_cont(v, 0.5) FILTER (bin BETWEEN onset - 5 AND onset - 1) AS b, quantile_cont(v, 0.5) FILTER (bin >= onset + 3) AS a FROM r JOIN profiles p USING (vec_id) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY onset) AS k FROM t WHERE b >= 0.04)
SELECT vec_id, onset, length FROM f WHERE k = 1 AND a <= 1.5 * 0.05"""
)
def notch_onset(spark, sf_dir):
    return w.notches(profiles(spark, sf_dir), ["vec_id"], "bin", "v", 0.05, 3, 0.04)


@query(
    f"""WITH {POINTS}, s AS (SELECT bag, frame_idx, lat, k FROM (SELECT DISTINCT bag, frame_idx, lat FROM points), range(0, 10) r(k)),
h AS (SELECT s.bag, s.frame_idx, s.lat, s.k, count(p.f) AS n FROM s LEFT JOIN points p ON p.bag = s.bag AND p.frame_idx = s.frame_idx AND p.lat = s.lat AND p.f > s.k * 5 GROUP BY ALL),
m AS (SELECT *, lag(n, 1) OVER w AS a, coalesce(lag(n, 6) OVER w, first_value(n) OVER w) AS b FROM h WINDOW w AS (PARTITION BY bag, frame_idx, lat ORDER BY k))
SELECT bag, frame_idx, lat, min(k)::INT AS k_drop FROM m WHERE a >= 5 AND n <= greatest(2.0, 0.25 * a) AND NOT (b > 10 * a + 2) GROUP BY ALL"""
)
def sharp_drop(spark, sf_dir):
    p, beam = points(spark, sf_dir), ["bag", "frame_idx", "lat"]
    beams = p.select(*beam).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    passed = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(9), (F.ceil(F.col("f") / 5) - 1).cast("int"))))).groupBy(*beam, "k").agg(F.count("*").alias("n"))
    dense = beams.join(passed, [*beam, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return w.sharp_drops(dense, beam, "k", "n", ratio=10.0)


@query(
    f"""WITH {SIGNAL}, c AS (SELECT bag, theta // 4 AS col, floor(d / 5)::BIGINT AS row_d, fam FROM signal JOIN (SELECT bag, max(d) * 0.8 AS wall FROM signal GROUP BY bag) USING (bag) WHERE floor(d / 5) < ceil((wall + 0.3) / 5))
SELECT bag, col, arg_min(struct_pack(row_d := row_d, fam := fam), struct_pack(row_d := row_d, k := list_position(['click', 'error', 'purchase', 'signup', 'view'], fam))).row_d AS row_d,
arg_min(struct_pack(row_d := row_d, fam := fam), struct_pack(row_d := row_d, k := list_position(['click', 'error', 'purchase', 'signup', 'view'], fam))).fam AS fam FROM c GROUP BY ALL"""
)
def first_lit_contour(spark, sf_dir):
    """Nearest lit row of each column, up to 0.3 m behind the wall."""
    s = signal(spark, sf_dir)
    c = s.select("bag", F.floor(F.col("theta") / 4).alias("col"), F.floor(F.col("d") / 5).alias("row_d"), "fam")
    walls = s.groupBy("bag").agg(F.ceil((F.max("d") * 0.8 + 0.3) / 5).alias("last_row"))
    return w.first_lit(c, ["bag"], "col", "row_d", "fam", ["click", "error", "purchase", "signup", "view"], walls)


def _crossing(agg: str) -> str:
    return f"""WITH {PROFILES}, l AS (SELECT vec_id, bin, v, lag(v) OVER o AS b, lag(bin) OVER o AS t FROM profiles WINDOW o AS (PARTITION BY vec_id ORDER BY bin))
SELECT vec_id, {agg}((t + bin) / 2.0::DOUBLE) AS t_cross FROM l WHERE b * v <= 0 AND b <> 0 GROUP BY ALL"""


@query(_crossing("min"))
def first_crossing(spark, sf_dir):
    return w.first_crossing(profiles(spark, sf_dir), ["vec_id"], "bin", "v")


@query(_crossing("max"))
def last_crossing(spark, sf_dir):
    return w.first_crossing(profiles(spark, sf_dir), ["vec_id"], "bin", "v", last=True)


@query(f"WITH {SIGNAL} SELECT event_id, round(quantile_cont(CASE WHEN fam <> 'error' THEN d END, 0.5) OVER (PARTITION BY bag ORDER BY frame_idx RANGE BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS median FROM signal")
def centre_median_11(spark, sf_dir):
    return w.window_median(signal(spark, sf_dir), ["bag"], "frame_idx", "d", 10, F.col("fam") != "error").select("event_id", F.round("median", 6).alias("median"))


@query(f"WITH {SIGNAL} SELECT event_id, last_value(CASE WHEN fam = 'purchase' THEN d END IGNORE NULLS) OVER (PARTITION BY bag ORDER BY frame_idx RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS last_real FROM signal")
def last_real_within_7(spark, sf_dir):
    return w.last_within(signal(spark, sf_dir), ["bag"], "frame_idx", F.when(F.col("fam") == "purchase", F.col("d")), 7).select("event_id", "last_real")


@query(f"WITH {SIGNAL} SELECT event_id, last_value(CASE WHEN frame_idx % 2 = 0 THEN d END IGNORE NULLS) OVER (PARTITION BY bag ORDER BY frame_idx) AS held FROM signal")
def hold_every_second(spark, sf_dir):
    return w.hold_between(signal(spark, sf_dir), ["bag"], "frame_idx", "d").select("event_id", "held")
