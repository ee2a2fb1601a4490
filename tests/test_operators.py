"""Operators on rows counted by hand, with the quirk switches."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeforge.config import AxisSpec, Grid
from rangeforge.functions import geometry as g
from rangeforge.operators import aggregates, fits, folds, grids, matching, selection, windows
from rangeforge.sources import images
from rangeforge.sources.calibration import make_nodes
from rangeforge.streaming import online


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_projection(spark):
    u, v = g.perspective(2.0, -1.0, 10.0, 30.0)
    r, a = g.polar(-3.0, 4.0)
    x, y = g.pinhole(1.0, 2.0, -1.0, 900, 900, 640, 360)
    row = one(spark, u, v, r, a, x, g.bin_index(0.3, 0.0, 0.1), g.bin_index(-0.05, 0.0, 0.1), g.half_even(2.5), g.bearing_about(0.0, -1.0, 0.0, 0.0))
    assert list(row)[:4] == [6.0, -3.0, 5.0, pytest.approx(53.130102)] and row[4] is None and row[5:8] == (3, 0, 2.0) and row[8] == 270.0


def test_lines(spark):
    p, q = g.line_through(0.0, 0.0, 10.0, 10.0), g.line_through(0.0, 10.0, 10.0, 0.0)
    row = one(spark, g.cross_lines(p, q), g.cross_lines(p, p), g.line_distance(p, 5.0, 5.0), g.clip_line(p, 100.0, 50.0), g.vanishing_direction((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)), g.cross_planes([(1, 0, 0, 1), (0, 1, 0, 2), (0, 0, 1, 3)]))
    assert tuple(row[0]) == pytest.approx((5, 5)) and row[1] is None and row[2] == pytest.approx(0)
    assert [tuple(x) for x in row[3]] == [pytest.approx((0, 0)), pytest.approx((50, 50))] and tuple(row[4]) == (0, 0, 1) and tuple(row[5]) == (1, 2, 3)
    assert g.rotation(0, 0, 0).tolist() == [[1, 0, 0], [0, -1, 0], [0, 0, 1]]
    assert g.canonical(AxisSpec()) is not None


def test_histograms_keep_all_points(spark):
    pts = spark.createDataFrame([(0, k % 3, 1.0 + k, (k % 7) - 3.0, (k % 5) - 2.0, 1.0) for k in range(300)], "bag long, frame_idx long, f double, lat double, ver double, intensity double")
    grid = Grid()
    cells = grids.plane_cells(pts, 30.0, grid)
    assert grids.z_buffer(cells, ["bag"], 30.0).count() == cells.select("iu", "iv").distinct().count()
    h = grids.screen_histogram(pts, [10.0, 50.0], 5.0, Grid(-1e6, 1e6, -1e6, 1e6, 1.0))
    assert h.agg(F.sum("n")).first()[0] == sum((1.0 + k > d + 5) for k in range(300) for d in (10.0, 50.0))
    stacks = grids.stacked(spark.createDataFrame([(k,) for k in range(10)], "frame_idx long"), 3, 2).groupBy("stack").agg(F.sort_array(F.collect_list("frame_idx")).alias("f"))
    assert {r.stack: r.f for r in stacks.collect()} == {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5, 6], 3: [6, 7, 8], 4: [8, 9]}


def test_junk_mask_quirk(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 3)], "d_idx int, theta_idx int, n int")
    mask = spark.createDataFrame([(1, 0)], "d_idx int, theta_idx int")
    assert sorted(map(tuple, matching.junk_removed(cells, mask).collect())) == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]
    assert sorted(map(tuple, matching.junk_removed(cells, mask, compat=True).collect())) == [(0, 0, 1), (0, 2, 1)]


def test_interpolation_is_exact_at_nodes(spark):
    nodes = make_nodes(spark)
    got = matching.interpolate_line(nodes.select("fan", "d", F.col("x0").alias("want")), nodes, "d").collect()
    assert len(got) == 84 and all(r.x0 == pytest.approx(r.want) for r in got)
    out = matching.interpolate_line(spark.createDataFrame([("L", 0.1), ("L", 99.0)], "fan string, d double"), nodes, "d").collect()
    ends = {r.d: r.x0 for r in nodes.where("fan = 'L'").collect()}
    assert sorted(r.x0 for r in out) == pytest.approx(sorted([ends[2.0], ends[max(ends)]]))


def test_consensus_of_a_whole_recording(spark):
    states = spark.createDataFrame([(0, k, 1, 1, 1 if k % 2 else 2) for k in range(10)] + [(0, k, 2, 2, 1) for k in range(9)], "bag long, frame_idx long, iu int, iv int, st int")
    whole = windows.global_consensus(states, ["bag"], 0.5)
    last = windows.sliding_consensus(states, "bag", 10, 0.5, current=True)
    assert [(r.iu, r.share) for r in whole.collect()] == [(2, 0.9)] == [(r.iu, r.share) for r in last.collect()]


def test_thresholds_and_axes(spark):
    rows = spark.createDataFrame([(0, v) for v in range(100)], "k int, v int")
    assert aggregates.order_statistic_threshold(rows, ["k"], "v").first().threshold == 55.0
    cloud = spark.createDataFrame([(k * 0.01, -k * 1.0, (k % 3) * 0.1) for k in range(200)], "x double, y double, z double")
    assert tuple(aggregates.detect_axes(cloud, ["x", "y", "z"]).first()) == ("y", -1, "x", "z")


def test_folds(spark):
    rows = spark.createDataFrame([("a", k, float(x), 0.0) for k, x in enumerate([0, 1, 5, 5.5, 10])], "g string, k long, x double, y double")
    assert [r.kept for r in folds.suppressed(rows, ["g"], ["k"], ["x", "y"], [2.0, 1.0]).orderBy("k").collect()] == [True, False, True, False, True]
    assert [r.seed for r in folds.anchored_groups(rows, ["g"], ["k"], ["x", "y"], [2.0, 1.0]).orderBy("k").collect()] == [0, 0, 1, 1, 2]
    levels = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, None), ("a", 3, 1.2), ("a", 4, 1.3)], "g string, k long, v double")
    # the jump to 5 counts as another 1.0, so the medians are of 1, 1 1, 1 1, 1 1 1.2 and 1 1 1.2 1.3
    assert [r.level for r in folds.rail_levels(levels, ["g"], "k", "v").orderBy("k").collect()] == pytest.approx([1.0, 1.0, 1.0, 1.0, 1.1])
    smooth = folds.recursive_median(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([0, 9, 0, 9, 9])], "g string, k long, v double"), ["g"], "k", "v", half=1)
    assert [r.smooth for r in smooth.orderBy("k").collect()] == [4.5, 4.5, 4.5, 9.0, 9.0]


def test_point_filters(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (nan, 1.0, 1.0), (inf, 1.0, 1.0), (100.0, 1.0, 1.0), (1.0, 250.0, 1.0), (1.0, 1.0, 50.0), (None, 1.0, 1.0), (0.1, 0.1, 0.1)], "x double, y double, z double")
    assert rows.where(selection.valid_cloud()).count() == 2 and rows.where(selection.away_from_sensor()).count() == 4


def test_corner_and_details(spark):
    line = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
    base = spark.range(1).select(F.lit(1).alias("k"))
    side = base.select("k", line(1.0, 0.0, -100.0).alias("line"), F.lit(95.0).alias("x_lo"), F.lit(105.0).alias("x_hi"), F.lit(0.0).alias("y_lo"), F.lit(400.0).alias("y_hi"), F.lit(3.0).alias("d"))
    bottom = base.select("k", line(0.0, 1.0, -300.0).alias("line"), F.lit(90.0).alias("x_lo"), F.lit(600.0).alias("x_hi"), F.lit(290.0).alias("y_lo"), F.lit(310.0).alias("y_hi"), F.lit(4.0).alias("d"))
    assert tuple(matching.corner_of(side, bottom, ["k"]).first()) == (1, 100.0, 300.0, 4.0)
    d = spark.createDataFrame([(1, 50, 10.0, 10.0), (1, 51, 10.0, 10.0)], "k int, n int, x double, y double")
    s = spark.createDataFrame([(1, 50, 11.0, 9.5, 7)], "k int, n int, x double, y double, segment_id int")
    assert [(r.n, r.segment_id) for r in matching.matched_segments(d, s, ["k"]).collect()] == [(50, 7)]


def png(path, rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    png(folder / "a.png", [[0, 10, 0], [0, 0, 200]])
    png(folder / "b.png", [[0, 0, 0], [0, 0, 0]])
    assert sorted((r.x, r.y, r.gray) for r in images.read_frames(spark, str(folder)).collect()) == [(1, 0, 10), (2, 1, 200)]
    (tmp_path / "d.csv").write_text("n,distance\n1,2.5\n2,x\n3,4.0\n")
    assert [r.distance_m for r in images.calibration_set(spark, str(folder), str(tmp_path / "d.csv")).orderBy("i").collect()] == [2.5, 4.0]
    png(folder / "c.png", [[1]])
    with pytest.raises(ValueError, match="3 images"):
        images.calibration_set(spark, str(folder), str(tmp_path / "d.csv"))
    q = online.write_batches(images.watch_frames(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert sorted((r.path[-5:], r.x, r.y, r.gray) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.png", 1, 0, 10), ("a.png", 2, 1, 200), ("c.png", 0, 0, 1)]


def test_canvas(spark):
    pts = spark.createDataFrame([(40.0, 1.0, 1.0), (50.0, -2.0, 0.0)], "f double, lat double, ver double")
    assert online.canvas(pts, 30.0, 0.5, 0.1).u_lo < 0
    with pytest.raises(ValueError, match="canvas"):
        online.canvas(pts, 60.0, 0.5, 0.1)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_over_batches(size):
    """Whole groups whatever the batches, null keys among them."""
    import pyarrow as pa

    from rangeforge.operators.ordered import whole_groups

    rows = pa.record_batch({"k": pa.array([1, 1, 1, 1, 1, None, None, 2, 3, 3]), "v": pa.array(range(10))})
    batches = [rows.slice(i, size) for i in range(0, 10, size)]
    groups = []
    for batch, starts in whole_groups(iter([rows.slice(0, 0), *batches]), ["k"]):
        v = batch.column(1).to_pylist()
        groups += [v[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(v)], strict=True)]
    assert groups == [[0, 1, 2, 3, 4], [5, 6], [7], [8, 9]] and not list(whole_groups(iter([]), ["k"]))


def test_vanishing_centre_bounds(spark):
    """One crossing off the image leaves the other; none leaves the default."""
    def centre(left, right):
        lines = {"L": (left, 0.1), "R": (right, -0.1), "B": (300.0, 0.05)}
        rows = [(fan, float(d), x0 + 10.0 / d, m) for fan, (x0, m) in lines.items() for d in (2, 4, 8, 16)]
        return tuple(fits.vanishing_centre(spark.createDataFrame(rows, "fan string, d double, x0 double, m double")).first())

    meet = lambda x0, m: (m * (300.0 - 0.05 * 640 - 360) + x0) / (1 - m * 0.05)
    one, two = meet(500.0, 0.1), meet(800.0, -0.1)
    assert centre(500.0, 800.0)[0] == pytest.approx((one + two) / 2) and centre(5000.0, 800.0)[0] == pytest.approx(two) and centre(500.0, -4000.0)[0] == pytest.approx(one)
    assert centre(5000.0, -4000.0) == (614.0, 225.0)


def test_line_index(spark):
    """The nearest lines by the index equal those of the whole grid: lines of any length, far and missing pixels, ties; the lists are short."""
    rng = np.random.default_rng(8)
    grid = [(fan, float(d), (float(np.cos(t) * w), float(np.sin(t) * w), float(-c * w))) for fan in "LR" for d, (t, c, w) in enumerate(zip(rng.normal(0.4, 0.05, 300), np.linspace(0, 1300, 300), rng.choice([0.5, 1, 2], 300)))]
    grid += [("L", 1000.0, grid[150][2])]  # a line that is there twice
    places = [(k, *p) for k, p in enumerate(np.vstack([rng.uniform(-50, 1300, (400, 2)), [[3e6, 5.0], [1e9, -1e9], [0.0, 0.0], [16.0, 32.0]]]).tolist())]
    lines = spark.createDataFrame(grid, "fan string, d double, line struct<a: double, b: double, c: double>")
    pixels = spark.createDataFrame([*places, (-1, None, 1.0)], "k int, x double, y double")
    got = {(r.k, r.fan): r for r in matching.nearest_line(pixels, ["k"], lines, "x", "y").collect()}
    assert len(got) == 2 * len(places) + 2 and got[-1, "L"].residual is None
    for k, x, y in places:
        for fan in "LR":
            miss, d = min((abs(a * x + b * y + c), d) for f, d, (a, b, c) in grid if f == fan)
            assert (got[k, fan].d, got[k, fan].residual) == (d, pytest.approx(miss))
    measured = [(k, (float(np.cos(t)), float(np.sin(t)), float(-c))) for k, (t, c) in enumerate(zip(rng.normal(0.4, 0.2, 200), rng.uniform(0, 1300, 200)))]
    fitted = matching.fit_line_distance(spark.createDataFrame(measured, "k int, m struct<a: double, b: double, c: double>"), ["k"], lines, "m").collect()
    assert len(fitted) == 400
    for r in fitted:
        a, b, c = measured[r.k][1]
        probes = [(s * b - a * c, -s * a - b * c) for s in (100, -100)]
        assert (r.error, r.d) == pytest.approx(min((max(abs(p * x + q * y + o) for x, y in probes), d) for f, d, (p, q, o) in grid if f == r.fan))
    cells = spark.createDataFrame([([k, k],) for k in range(1, 60)], "place array<bigint>")
    assert matching.line_index(cells, lines, 1).agg(F.avg(F.size("near"))).first()[0] < 30


def test_window_excess(spark):
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 3, (9, 12))
    cells = spark.createDataFrame([("a", int(i), int(j), int(n)) for (i, j), n in np.ndenumerate(dense) if n], "bag string, d_bin int, y_bin int, n long")
    got = {(r.d_bin, r.y_bin): r.n for r in fits.window_excess(cells, ["bag"], 3, 4).collect()}
    around = np.pad(dense, ((2, 2), (3, 3)))
    want = {(i - 2, j - 3): int(around[i : i + 3, j : j + 4].sum()) for i in range(11) for j in range(15)}
    assert got == {k: n for k, n in want.items() if n}
    assert fits.window_excess(cells.limit(0), ["bag"], 3, 4).count() == 0


def test_matrix_sampling(spark):
    """Each cell's pixel by plain geometry; cells off the image are none, a pixel named twice counts once, families are counted up to three."""
    lines = spark.createDataFrame([(fan, float(d), (1.0, 0.0, -float(x))) for fan, x0 in (("L", 100), ("R", 100), ("B", 900)) for d, x in ((2, x0), (3, x0 + 379.4))], "fan string, d double, line struct<a: double, b: double, c: double>")
    got = {(r.fan, r.d_idx, r.theta_idx): (r.px, r.py) for r in grids.sample_geometry(lines, (50.0, 300.0), 30.0).collect()}
    want = {}
    for fan, x0 in (("L", 100.0), ("R", 100.0), ("B", 900.0)):
        for k, x in enumerate((x0, x0 + 379.4)):
            for i in range(12):
                ux, uy = np.cos(np.radians(30 * i)), np.sin(np.radians(30 * i))
                t = (x - 50) / ux if abs(ux) > 1e-9 else -1
                if t >= 1 and 0 <= 50 + t * ux <= 1279 and 0 <= 300 + t * uy <= 719:
                    want[fan, k, i] = (round(50 + t * ux), round(300 + t * uy))
    assert got == want and not any(k == ("B", 1, 0) for k in got)
    geometry = spark.createDataFrame([(*k, *v) for k, v in got.items()], "fan string, d_idx int, theta_idx int, px int, py int")
    mask = spark.createDataFrame([("a", 100, 300), ("a", 100, 300), ("a", 5, 5), ("b", 900, 300)], "bag string, x int, y int")
    assert {tuple(r) for r in matching.sampled_cells(geometry, mask, ["bag"]).collect()} == {("a", 0, 0, 2), ("b", 0, 0, 1)}
    assert matching.sampled_cells(geometry, mask.limit(0), ["bag"]).count() == 0


def test_inverse_fit_without_distance(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 5.0), ("b", 2.0, 4.0)], "g string, d double, y double")
    a, b = fits.inverse_fit(rows, ["g"], "d", "y").orderBy("g").collect()
    assert a.v0 is None and np.isnan(a.k) and (b.v0, b.k) == pytest.approx((3.0, 2.0))


def test_extrapolated_at_the_asymptote(spark):
    rows = spark.createDataFrame([(230.0,), (630.0,), (231.0,)], "y0 double")
    assert [r.d for r in rows.select(fits.extrapolated(F.col("y0"), F.lit(230.0), F.lit(480.0)).alias("d")).collect()] == [None, 1.2, None]


def test_rays_along_planes_and_sheets(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,)], "u double")
    assert [r.z for r in rows.select(g.ray_plane(F.col("u"), F.lit(0.0), 1, 1, 0, 0, 1, 0, 0, 2.0).alias("z")).collect()] == [None, 2.0]
    line = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(-20.0).alias("c"))
    assert [r.p and r.p.x for r in rows.select(g.ray_sheet(10.0, 10.0, F.col("u") * 90, line).alias("p")).collect()] == [None, pytest.approx(10.0)]


def test_boxes_that_just_touch(spark):
    """Each box grows by its own edges: so rounded they touch, though their distance is rounded to more than both growths."""
    first, then = 2.06, 42.06
    assert (first + 20) + 10 >= then - 10 and not first + 20 >= then - 20
    boxes = spark.createDataFrame([(0, 1, first, first + 20), (1, 2, then, then + 20)], "frame long, box_id long, x_lo double, x_hi double").selectExpr("0 AS bag", "*", "0D AS y_lo", "40D AS y_hi")
    assert [r.box_id for r in matching.overlapping_before(boxes, ["bag"], "frame", 3, 10.0, 50.0).collect()] == [2]


def test_moving_median_looks_within_reach(spark):
    """A null gives way to the row itself, as in SQL, not to a value at the far end of the recording; no frame runs on to that end."""
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate([5.0, 9.0, None, 7.0, 1.0])], "g string, k long, v double")
    found = windows.moving_median(rows, ["g"], "k", "v")
    assert [r.smooth for r in found.orderBy("k").collect()][:2] == [5.0, 9.0]
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_folds_of_many_groups(spark):
    """Thousands of small groups pass through few tasks, across the ends of batches; a group that no batch holds stays whole, and groups of nulls are groups."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = {g: 1 + g * 7 % 23 for g in range(300)} | {300: 500, None: 9}
        rows = spark.createDataFrame([(g, k, float((k * 13 + (g or 0)) % 40), "s") for g, n in sizes.items() for k in range(n)], "g long, k long, x double, s string")
        got: dict = {}
        for r in folds.suppressed(rows, ["g"], ["k"], ["x"], [3.0]).collect():
            got.setdefault(r.g, []).append((r.k, r.x, r.kept, r.s))
        assert {g: len(v) for g, v in got.items()} == sizes
        for found in got.values():
            kept: list = []
            for _, x, yes, _ in sorted(found):
                assert yes == (not any(abs(x - q) <= 3.0 for q in kept))
                kept += [x] if yes else []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
