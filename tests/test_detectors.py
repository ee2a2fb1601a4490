"""Detectors on made scenes with known answers."""

import math

import numpy as np
import pytest

from rangeforge.operators import camera, lidar
from rangeforge.operators.clusters import eps_labels, join_pairs, label_cells
from rangeforge.operators.fits import isotonic_values, poisson_critical
from rangeforge.operators.folds import tracked


@pytest.fixture(scope="module")
def grid():
    d = np.round(np.arange(2.0, 12.01, 0.1), 6)
    def lines(vertical, a, k, s, t):
        m, x0 = s + t / d, a + k / d
        n = np.sqrt(1 + m * m)
        return np.stack([1 / n, -m / n, (m * 360 - x0) / n] if vertical else [-m / n, 1 / n, (m * 640 - x0) / n], axis=1)

    return camera.LineGrid(d, {"L": lines(True, 600, -420, 0.03, 0.02), "R": lines(True, 640, 430, -0.03, -0.02), "B": lines(False, 230, 480, 0.01, 0.02)})


def scene(grid, d):
    gray = np.zeros((720, 1280), np.int64)
    for fan in grid.fans:
        a, b, c = grid.at(fan, d)
        if fan == "B":
            x = np.arange(300, 981)
            for k in range(-2, 3):
                gray[np.rint(-(a * x + c) / b).astype(int) + k, x] = 220
        else:
            y = np.arange(150, 700)
            x = np.rint(-(b * y + c) / a).astype(int)
            for k in range(-2, 3):
                gray[y, x + k] = 220
    return gray


def test_top_hat():
    gray = np.zeros((100, 100), np.int64)
    gray[20:80, 20:80] = 200
    gray[5:8, 50:62] = 240
    mask = camera.laser_mask(gray)
    assert mask[6, 55] and not mask[50, 50]


@pytest.mark.parametrize("d", [3.0, 4.0])
def test_spot_on_a_line(grid, d):
    coarse = np.arange(0, len(grid.d), 2)
    grid = camera.LineGrid(grid.d[coarse], {fan: v[coarse] for fan, v in grid.fans.items()})
    gray = np.zeros((720, 1280), np.int64)
    a, b, c = grid.at("B", d)
    x = np.arange(900, 914)
    y = np.rint(-(a * x + c) / b).astype(int)
    for k in range(-4, 5):
        gray[y + k, x] = 240
    gray[400, 300:302] = 255
    found = camera.find_spots(camera.laser_mask(gray), gray, grid, (614.0, 225.0))
    assert found and min(found)[0] == pytest.approx(d, abs=0.35) and min(found)[2] == "B"
    assert not camera.find_spots(camera.laser_mask(gray), gray, grid, (614.0, 225.0), wall=d)


def test_spots_of_stacked_frames_are_those_of_whole_frames(spark, grid, monkeypatch):
    monkeypatch.setattr(camera, "PIXELS_AT_ONCE", 10_000)
    rng, rows, whole = np.random.default_rng(3), [], {}
    for k in range(24):
        gray = np.zeros((720, 1280), np.int64)
        for d, lo in ((rng.uniform(2.2, 9), int(rng.integers(0, 1266))), (rng.uniform(2.2, 9), int(rng.integers(400, 900)))):
            a, b, c = grid.at("B", d)
            y = int(np.rint(-(a * lo + c) / b))
            gray[max(0, y - 4) : y + 5, lo : lo + int(rng.integers(3, 15))] = rng.integers(150, 256)
        if k % 5 == 0:
            gray[100:132, 200:232] = 255  # bright enough to tell in the sample, beside the border of one frame in two
            gray[:40, : 30 * (k % 2)] = 90
        ys, xs = np.nonzero(gray)
        rows.append((k, xs.tolist(), ys.tolist(), gray[ys, xs].tolist()))
        found = camera.find_spots(camera.laser_mask(gray), gray, grid, (614.0, 225.0))
        if found:
            whole[k] = min(found)
    frames = spark.createDataFrame([*rows, (99, [], [], [])], "frame long, x array<int>, y array<int>, gray array<int>")
    get = lambda df: {r["frame"]: (r["d"], r["theta"], r["fan"], r["pixels"]) for r in df.collect()}
    assert len(whole) > 10
    assert get(camera.packed_spots(frames, ["frame"], grid, (614.0, 225.0))) == whole
    assert get(camera.spots(frames.selectExpr("frame", "inline(arrays_zip(x, y, gray))"), ["frame"], grid, (614.0, 225.0))) == whole


def test_frames_are_cut_close_and_masked_as_whole_ones():
    """Around pixels off the border only what dilate sees is kept; the mask is that of the whole frame."""
    rng, frames = np.random.default_rng(5), []
    for x0, y0 in ((300, 200), (16, 16), (1248, 300), (0, 40), (1266, 711), (700, 700)):
        x, y = np.meshgrid(np.arange(x0, x0 + 14), np.arange(y0, y0 + 9))
        frames.append((x.ravel(), y.ravel(), rng.integers(0, 256, x.size)))
    many = np.full(len(frames), 126)
    seen = {}
    for own, stack, mask, x0, y0 in camera._crops(*(np.concatenate(v) for v in zip(*frames, strict=True)), many, 1280, 720):
        for k, frame in enumerate(own.tolist()):
            x, y, level = frames[frame]
            whole = np.zeros((720, 1280), np.int64)
            whole[y, x] = level
            want, part = camera.laser_mask(whole), np.s_[y0[k] : y0[k] + stack.shape[1], x0[k] : x0[k] + stack.shape[2]]
            assert (mask[k] == want[part]).all() and mask[k].sum() == want.sum() and (stack[k] == whole[part]).all()
            seen[frame] = stack.shape[1:]
    assert seen[0] == seen[1] == seen[2] == (11, 16) and min(seen[k][0] for k in (3, 4, 5)) >= 25


def test_masks_of_a_stack_are_labelled_as_each_alone():
    masks = np.random.default_rng(2).random((20, 17, 23)) < np.linspace(0, 0.9, 20)[:, None, None]
    for mask, found in zip(masks, camera.labelled_each(masks), strict=True):
        assert [p.tolist() for p in found] == [p.tolist() for p in camera.labelled(mask)]


def test_frames_without_pixels_leave_the_others_alone(spark, grid):
    grid = camera.LineGrid(grid.d[::2], {fan: v[::2] for fan, v in grid.fans.items()})
    a, b, c = grid.at("B", 4.0)
    x = np.repeat(np.arange(900, 914), 9)
    y = np.rint(-(a * x + c) / b).astype(int) + np.tile(np.arange(-4, 5), 14)
    good = (x.tolist(), y.tolist(), [240] * 126)
    frames = spark.createDataFrame([(1, good[0], None, good[2]), (2, *good), (3, None, None, None), (4, *good)], "frame long, x array<int>, y array<int>, gray array<int>").coalesce(1)
    found = {r["frame"]: r[1:] for r in camera.packed_spots(frames, ["frame"], grid, (614.0, 225.0)).collect()}
    assert set(found) == {2, 4} and found[2] == found[4]


def test_frames_of_spots_come_as_a_row_each(spark):
    from rangeforge.plans.detector_queries import frames_with_spots

    frames = frames_with_spots(spark, "/root/testdata/sf0.001")
    assert frames.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert frames.selectExpr("min(size(x))", "max(size(gray))").first()[:] == (126, 126)


@pytest.fixture(scope="module")
def maps():
    d = 2.0 + 0.4 * np.arange(28)
    return {name: camera.FanMap(vertical, d, a + k / d, s + t / d) for name, vertical, a, k, s, t in (("L", True, 600, -420, 0.03, 0.02), ("R", True, 640, 430, -0.03, -0.02), ("B", False, 230, 480, 0.01, 0.02))}


@pytest.mark.parametrize("d", [3.0, 4.0, 6.0])
def test_measured_distance(grid, maps, d):
    m = camera.measure_frame(scene(grid, d), maps)
    # The probes lie at the image's origin, off the bottom line's segments, so that a segment's tilt tells as much as for the sides.
    assert m["fans"] == {fan: pytest.approx(d, abs=0.2) for fan in "LRB"}
    segments = camera.find_lines(scene(grid, d))[0]
    assert m["fans"]["B"] == pytest.approx(min(plain_fit(maps["B"], (s.a, s.b, s.c))[0] for s in segments), abs=1e-6)
    assert m["closest"] == pytest.approx(d, abs=0.2) and not m["marks"]
    assert {c[0] for c in m["corners"]} == {"L", "R"} and all(c[3] == pytest.approx(d, abs=0.2) for c in m["corners"])


def plain_fit(own, line):
    """The three scans, one distance at a time; probes 100 pixels to both sides of the line's point nearest to the image's origin."""
    def error(d):
        x0, m = np.interp(d, own.d, own.x0), np.interp(d, own.d, own.m)
        a, b, c = (1.0, -m, m * 360 - x0) if own.vertical else (-m, 1.0, m * 640 - x0)
        n = np.hypot(a, b)
        x, y = -line[2] * line[0], -line[2] * line[1]
        return max(abs((a * (x - t * line[1]) + b * (y + t * line[0]) + c) / n) for t in (-100, 100))

    best, least = own.d[0], np.inf
    for n, span in ((300, None), (40, 0.2), (10, 0.02)):
        lo, hi = (own.d[0], own.d[-1]) if span is None else (max(own.d[0], best - span), min(own.d[-1], best + span))
        for d in np.linspace(lo, hi, n):
            if error(d) < least - 1e-12:
                best, least = d, error(d)
    return best, least


def test_refined_lookup(spark, maps):
    from rangeforge.plans.detector_queries import calib_refined
    from rangeforge.sources.driver import signal

    for own in maps.values():
        for d in (2.0, 3.3333, 7.77, 12.5):
            line = tuple(own.lines(d)[0])
            assert own.fit_distance(line)[0] == pytest.approx(d, abs=0.01) and own.fit_distance(line)[1] < 0.5
    sf = "/root/testdata/sf0.001"
    lines = {r.event_id: (np.cos(np.radians(r.theta)), np.sin(np.radians(r.theta)), r.d - 300) for r in signal(spark, sf).collect()}
    rows = calib_refined(spark, sf).collect()
    assert len(rows) == 3 * len(lines)
    for r in rows[::97]:
        d, error = plain_fit(maps[r.fan], lines[r.event_id])
        assert r.error == pytest.approx(error, abs=1e-3) and (r.d == pytest.approx(d, abs=1e-3) or error > 50)


def test_a_missing_line_is_found_with_guesses(grid, maps):
    gray = scene(grid, 4.0)
    # The right line is broken up, so that no column of it is full.
    x = np.nonzero(gray[200:600, 700:900].any(axis=0))[0] + 700
    gray[160:690, x.min() : x.max() + 1] *= (np.arange(160, 690) % 24 < 3)[:, None]
    assert "R" not in camera.measure_frame(gray, maps, guided=False)["fans"]
    assert camera.measure_frame(gray, maps)["fans"]["R"] == pytest.approx(4.0, abs=0.3)
    assert not camera.measure_frame(scene(grid, 4.0), maps, least_brightness=230.0)["fans"]


def test_model_takes_the_place_of_maps(grid, maps):
    model = lambda fan, d: np.array([maps[fan].lines(v)[0] for v in d])
    only_bottom = {"B": maps["B"]}
    gray = scene(grid, 5.0)
    segments = camera.assigned(*camera.find_lines(gray), maps)
    found = camera._distances(segments, only_bottom, model, 15.0)
    assert {fan: min(d for d, _ in own) for fan, own in found.items()} == {fan: pytest.approx(5.0, abs=0.2) for fan in "LRB"}


def measured(spark, maps, scenes, **rules):
    """measurements() of whole images, by name."""
    rows = [(name, int(x), int(y), int(gray[y, x])) for name, gray in scenes.items() for y, x in np.argwhere(gray)]
    found = camera.measurements(spark.createDataFrame(rows, "name string, x int, y int, gray int"), ["name"], maps, **rules).collect()
    return {r["name"]: r for r in found}


def test_near_marks(spark, grid, maps):
    """Marks by the rules: what is near, how far, what is a broken line, what no reading supports."""
    scenes = {}

    def with_marks(name, *marks, d=4.0):
        gray = scenes[name] = scene(grid, d)
        for x, y, w, h in marks:
            gray[y : y + h, x : x + w] = 220

    level = 230 + 480 / 4.0
    y3 = int(230 + 480 / 3.2 + (0.01 + 0.02 / 3.2) * (580 - 640))
    y2 = 230 + 480 / 2.0
    a, b, c = grid.at("L", 4.0)
    with_marks("none")
    with_marks("dot", (575, y3 - 4, 9, 9))
    with_marks("flat", (560, y3 - 3, 60, 6))
    with_marks("below", (575, int(y2) + 30, 9, 9), d=2.4)
    with_marks("low", (575, 640, 9, 9))
    with_marks("outside", (200, int(level) + 60, 9, 9))
    with_marks("top", (575, 100, 9, 9))
    with_marks("above", (575, 250, 9, 9))
    with_marks("row", *[(int(-(b * y + c) / a) + 12, y, 4, 4) for y in (420, 450, 480)])
    m = measured(spark, maps, scenes)
    assert not m["none"]["near"] and m["none"]["closest"] == pytest.approx(4.0, abs=0.2)
    (dot,) = m["dot"]["near"]
    assert dot["kind"] == "dot" and dot["near"] and dot["d"] == pytest.approx(3.2, abs=0.41)
    # A level mark of rows y3 - 3 to y3 + 2, as far as the bottom line is that fits it best.
    flat, _ = plain_fit(maps["B"], (0.0, 1.0, 0.5 - y3))
    assert m["flat"]["near"][0]["kind"] == "hline" and m["flat"]["near"][0]["near"] and m["flat"]["closest"] == m["flat"]["near"][0]["d"] == pytest.approx(flat, abs=1e-6)
    assert flat == pytest.approx(3.2, abs=0.2)
    (below,) = m["below"]["near"]
    assert below["near"] and 1.5 < below["d"] < 2.05
    (low,) = m["low"]["near"]
    assert low["d"] is not None and not low["near"]  # 1.2 m: no reading within half a metre below to two above
    assert not m["outside"]["near"]  # outside the corridor
    assert not m["top"]["near"]  # the top quarter
    assert m["above"]["near"][0]["near"] is False  # above the bottom line
    assert not [f for f in m["row"]["near"] if f["kind"] == "dot" and abs(a * f["x"] + b * f["y"] + c) <= 12]


def test_point_distance_and_branch(maps):
    bottom = maps["B"]
    assert bottom.below_range(640.0, 230 + 480 / 1.5) == pytest.approx(1.5, abs=0.01) and bottom.below_range(640.0, 300.0) is None
    assert camera.point_distance(bottom, 640.0, 230 + 480 / 4.4) == pytest.approx(4.4) and camera.point_distance(bottom, 640.0, 650.0) is None
    assert camera.point_distance(bottom, 640.0, 230 + 480 / 1.99) == pytest.approx(1.99, abs=0.02)
    assert bottom.quality(2.5) > bottom.quality(11.0) > 0


def test_segments_are_cut():
    x = np.arange(200.0)
    y = np.where(x < 100, 0.5 * x, 50 - 0.5 * (x - 100))
    found = camera.split_segments(x, y)
    assert len(found) >= 2 and all(s.rms < 1 for s in found)


def corridor(gap=5.0):
    """Floor and walls with a box at 45 to 47 m; what the box hides is not seen."""
    rng = np.random.default_rng(0)
    f = np.arange(2, 151, 0.2)
    floor = np.array([(a, b, -1.075) for a in f for b in np.linspace(-2.9, 2.9, 26)])
    walls = np.array([(a, s * 3.0, c) for a in f for s in (-1, 1) for c in np.linspace(-1.075, 2.5, 14)])
    back = np.concatenate([floor, walls])
    lo, hi = np.array([45, 0.5, -1.075]), np.array([47, 2.5, 0.925])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.stack([lo / back, hi / back])
    t0, t1 = np.nanmin(t, axis=0).max(axis=1), np.nanmax(t, axis=0).min(axis=1)
    back = back[~((t0 <= t1) & (t1 >= 0) & (t0 <= 0.999999))]
    faces = []
    for axis in range(3):
        for side in (lo, hi) if axis == 0 else (lo,):
            p = lo + rng.random((200, 3)) * (hi - lo)
            p[:, axis] = side[axis]
            faces.append(p)
    return np.concatenate([back, *faces])


def test_box_hides_what_is_behind(spark):
    from pyspark.sql import functions as F

    from rangeforge.config import Grid
    from rangeforge.operators.grids import screen_histogram

    pts = corridor()
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "f double, lat double, ver double")
    screens = [float(d) for d in range(5, 66, 5)]
    h = screen_histogram(df, screens, 5.0, Grid(-4.0, 4.0, -2.0, 3.0, 0.05))
    u = F.col("iu") * 0.05 - 4.0
    v = F.col("iv") * 0.05 - 2.0
    inside = lambda s: (u + s >= 0.58 * F.col("D") / 47) & (u + s <= 2.42 * F.col("D") / 47) & (v >= -0.99 * F.col("D") / 47) & (v <= 0.84 * F.col("D") / 47)
    rows = {r.D: r for r in h.groupBy("D").agg(F.sum(F.when(inside(0.0), F.col("n"))).alias("n"), F.sum(F.when(inside(3.0), F.col("n"))).alias("ref")).collect()}
    for d in screens:
        if d + 5 >= 47:
            assert (rows[d].n or 0) < max(5, 0.15 * (rows[d].ref or 0)) if d in rows else True
        elif d >= 20:
            assert rows[d].n > 0


def test_slices_find_the_box(spark):
    rng = np.random.default_rng(1)
    rows = []
    for frame in range(4):
        n = 0
        rail = [(s * 0.76 + rng.normal(0, 0.01), -y, -1.075 + rng.normal(0, 0.01)) for s in (-1, 1) for y in np.arange(2.5, 19.5, 0.2)]
        box = [(0.3 + 0.4 * rng.random(), -(20.4 + 0.3 * rng.random()), -0.6 + 0.4 * rng.random()) for _ in range(60)]
        for x, y, z in rail + box:
            rows.append(("a", frame, n, float(x), float(y), float(z), 10.0))
            n += 1
    cloud = spark.createDataFrame(rows, "bag string, frame_idx long, pt_idx int, x double, y double, z double, intensity double")
    found = lidar.slice_detections(cloud)
    boxes = [r for r in found.collect() if r.chunk == 10]
    assert len(boxes) == 4 and all(abs(r.cx - 0.5) < 0.1 and abs(r.d_fwd - 20.55) < 0.1 and r.npts == 60 for r in boxes)
    stable = [r for r in lidar.stable_slices(found, cloud).collect() if r.chunk == 10]
    assert len(stable) == 1 and stable[0].kind == "STABLE" and stable[0].seen_in_frames == 4


def test_shadow_box():
    rng = np.random.default_rng(2)
    n = 60000
    f = rng.uniform(5, 70, n)
    y, z = rng.uniform(-0.11, 0.11, n) * f, rng.uniform(-0.03, 0.04, n) * f
    hidden = (np.abs(y / f) < 0.02) & (np.abs(z / f) < 0.02) & (f > 32)
    f, y, z = f[~hidden], y[~hidden], z[~hidden]
    bf = rng.uniform(31.1, 31.9, 4000)
    by, bz = rng.uniform(-0.02, 0.02, 4000) * bf, rng.uniform(-0.02, 0.02, 4000) * bf
    boxes = lidar.shadow_boxes(np.concatenate([f, bf]), np.concatenate([y, by]), np.concatenate([z, bz]), np.arange(10.0, 66, 1), width=0.004, a_max=0.12, b_lo=-0.06, b_hi=0.06)
    assert boxes and 28 < boxes[0]["d1"] < 33 and boxes[0]["y_min"] < 0 < boxes[0]["y_max"]


def test_excess_box():
    rng = np.random.default_rng(3)
    grid = rng.poisson(2.0, (90, 70)).astype(float)
    grid[20, 30:50] += 20
    found = lidar.excess_boxes(grid)
    assert found[0][0] == "2x2" and abs(found[0][1] - 41) <= 1 and abs(found[0][2] - 0.5) <= 0.2


def test_clusters():
    cells = np.array([(0, 0), (1, 1), (1, 2), (5, 5)])
    assert label_cells(cells, 4).tolist() == [0, 1, 1, 3] and label_cells(cells, 8).tolist() == [0, 0, 0, 3]
    chain = np.stack([np.arange(50) * 0.2, np.zeros(50), np.zeros(50)], axis=1)
    assert len(set(eps_labels(chain, 0.25))) == 1 and len(set(eps_labels(chain, 0.15))) == 50
    up = np.array([(0.1, 0.1, 0.2), (0.1, 0.1, 0.3)])
    assert len(set(eps_labels(up, 0.25))) == 1 and len(set(eps_labels(up, 0.25, compat=True))) == 2
    same = np.array([(0.1, 0.1, 0.1), (0.1, 0.1, 0.12)])
    assert len(set(eps_labels(same, 0.25))) == 1 and len(set(eps_labels(same, 0.25, compat=True))) == 2
    assert join_pairs(5, np.array([4, 3, 2]), np.array([3, 2, 1])).tolist() == [0, 1, 1, 1, 1]


def test_numbers():
    assert isotonic_values(np.array([3.0, 1.0, 2.0, 5.0])).tolist() == [2.0, 2.0, 2.0, 5.0]
    assert poisson_critical(0.0) == 1 and poisson_critical(1.0) == 5
    out = tracked([5.0, 5.1, None, 5.0, 9.0], [350.0, 352.0, 0.0, 10.0, 10.0], 2, 0.3, 4.0, 0.8)
    assert out[2] == [1, 2, 0, 1, 1] and out[3] == [False, True, False, False, False] and out[0][1] == pytest.approx(5.02) and out[1][1] == 352.0
    tail = lambda m, k: sum(math.exp(j * math.log(m) - m - math.lgamma(j + 1)) for j in range(k, k + 400))
    for m in (0.3, 2.0, 80.0, 100.0, 120.0, 150.0, 190.0):
        k = poisson_critical(m)
        assert k == 200 or (tail(m, k) <= 0.01 < tail(m, k - 1))
    assert poisson_critical(120.0) == 147 and poisson_critical(190.0) == 200


def plain_beam(limits, at, az, el, d_min, d_max):
    """One beam, step by step: the last crossing of each surface."""
    a, e = np.radians(az), np.radians(el)
    ray = (np.sin(a) * np.cos(e), np.cos(a) * np.cos(e), np.sin(e))
    lim = lambda k, d: float(np.interp(d, at, [row[k] for row in limits]))
    out = {}
    for k, name in enumerate(("left", "right", "floor", "ceiling")):
        last = None
        for i in range(1, 1203):
            t0, t1 = 0.25 * i, 0.25 * (i + 1)
            g0, g1 = ((ray[0] if k < 2 else ray[2]) * t - lim(k, ray[1] * t) for t in (t0, t1))
            if ray[1] * t1 > 0 and ((g0 * g1 <= 0 and g0 != 0) if k < 2 else (g0 > 0 >= g1) if k == 2 else (g0 < 0 <= g1)):
                last = (t0 + t1) / 2
        if last is not None:
            x, d, z = (r * last for r in ray)
            if (lim(2, d) - 0.5 <= z <= lim(3, d) + 0.5 if k < 2 else abs(x) < min(-lim(0, d), lim(1, d)) - 0.3) and d_min <= d <= d_max:
                out[name] = (last, d)
    return out


def test_beams(spark):
    model = spark.createDataFrame([(7, k, -3.0 - k * 0.01, 3.0, -1.0, 4.0) for k in range(60)], "bag long, d_idx long, x_left double, x_right double, z_floor double, z_ceil double")
    beams = lidar.trace_beams(model, ["bag"], [-20.0, 0.0, 10.0], [0.0, -5.0, 9.0], d_min=5.0, d_max=100.0)
    rows = {(r.az, r.el, r.surface): r for r in beams.collect()}
    assert rows[10.0, 0.0, "right"].d == pytest.approx(3 / np.tan(np.radians(10)), abs=0.3) and rows[10.0, 0.0, "right"].angle == pytest.approx(80, abs=0.5)
    limits, at = [(-3.0 - k * 0.01, 3.0, -1.0, 4.0) for k in range(60)], 1.5 + 2.0 * (np.arange(60) + 0.5)
    want = {(az, el, name): hit for az in (-20.0, 0.0, 10.0) for el in (0.0, -5.0, 9.0) for name, hit in plain_beam(limits, at, az, el, 5.0, 100.0).items()}
    assert rows.keys() == want.keys() and all((rows[k].t, rows[k].d) == pytest.approx(want[k]) for k in want) and len(want) >= 6
    best = {r.surface: r for r in lidar.best_beams(beams, ["bag"]).collect()}
    for name in best:
        assert best[name].angle == min(r.angle for (_, _, s), r in rows.items() if s == name)
    aimed = {(r.surface, r.target): r.angle for r in lidar.best_beams(beams, ["bag"], [10.0, 25.0]).collect()}
    assert aimed == {(s, t): min(r.angle for (_, _, q), r in rows.items() if q == s and t - 3 < r.d <= t + 3) for s in best for t in (10.0, 25.0) if any(q == s and t - 3 < r.d <= t + 3 for (_, _, q), r in rows.items())}


def test_branches(spark):
    """A bent map: inside it is linear, outside each end's own branch takes over within the blend."""
    from rangeforge.operators.calibrate import branched_lines

    d = np.arange(2.0, 10.1, 0.5)
    x0 = np.where(d < 5, 100 + 50 / d, 80 + 150 / d)
    nodes = spark.createDataFrame([("L", float(a), float(b), 0.1 + 0.2 / float(a)) for a, b in zip(d, x0, strict=True)], "fan string, d double, x0 double, m double")
    asked = [0.5, 1.0, 1.9, 2.0, 3.3, 10.0, 10.1, 10.2, 30.0]
    got = {r.d: r for r in branched_lines(spark.createDataFrame([("L", v, 1) for v in asked] + [("X", 3.0, 1), ("L", None, 1)], "fan string, d double, _fanned int"), nodes, "d").collect()}
    assert sorted(got) == asked
    assert got[0.5].x0 == pytest.approx(200) and got[1.0].x0 == pytest.approx(150) and got[30.0].x0 == pytest.approx(85)
    assert got[1.9].x0 == pytest.approx((1 - 2 / 3) * 125 + 2 / 3 * (100 + 50 / 1.9))
    assert got[10.2].x0 == pytest.approx((1 - 1 / 3) * 95 + 1 / 3 * (80 + 150 / 10.2)) and got[10.1].x0 == pytest.approx(95)
    assert got[3.3].x0 == pytest.approx(np.interp(3.3, d, x0)) and got[0.5].m == pytest.approx(0.5)


def test_guided_fit():
    from rangeforge.operators.camera import guided_line, refine_line

    x = np.arange(0, 300.0)
    y = 0.2 * x + 40
    y[::25] += 60
    line = refine_line(x, y)
    assert line is not None and line.a * 100 + line.b * 60 + line.c == pytest.approx(0, abs=0.2)
    assert guided_line(x, y, (line.a, line.b, line.c + 5)) is not None and guided_line(x, y, (line.a, line.b, line.c + 40)) is None


def test_model_fit_recovers_lines():
    from rangeforge.operators.calibrate import FanModel, fit_model

    true = np.array([1.2, 0.02, -0.05, 0.01, 900, 900, 640, 360, 0.99, 0.05, -0.1, -0.8, 0.99, -0.05, 0.1, 0.8, 0.02, 0.995, 0.09, 0.4])
    samples = [(d, FanModel(true, ("L", "R", "B")).lines(d)) for d in np.arange(2.0, 10.0, 1.0)]
    start = true + np.array([0.05, 0.01, 0.01, -0.01, 10, -10, 5, 5] + [0.01, -0.01, 0.01, 0.03] * 3)
    model, cost, _ = fit_model(samples, FanModel(start, ("L", "R", "B")), rounds=100)
    assert cost < 1.0


def test_beams_of_every_bag(spark):
    from rangeforge.plans.detector_queries import AZIMUTHS, ELEVATIONS, beam_hits, beam_targets
    from rangeforge.sources.driver import points

    sf = "/root/testdata/sf0.001"
    rows = {(r.bag, r.az, r.el, r.surface): (r.t, r.d) for r in beam_hits(spark, sf).collect()}
    models = {}
    for r in lidar.tunnel_model(points(spark, sf), ["bag"]).orderBy("d_idx").collect():
        models.setdefault(r.bag, []).append([np.nan if v is None else v for v in (r.x_left, r.x_right, r.z_floor, r.z_ceil)])
    want = {(bag, az, el, name): hit for bag, m in models.items() for az in AZIMUTHS[::3] for el in ELEVATIONS for name, hit in plain_beam(m, 1.5 + 2.0 * (np.arange(len(m)) + 0.5), az, el, 3.0, 50.0).items()}
    assert want and {k: v for k, v in rows.items() if k[1] in AZIMUTHS[::3]} == {k: pytest.approx(v) for k, v in want.items()}
    assert beam_targets(spark, sf).count() > 0


def plain_excess(grid):
    """Windows cell by cell, as the rules say."""
    n, m = grid.shape
    over = np.zeros((n, m))
    for i in range(n):
        for j in range(m):
            over[i, j] = grid[i, j] / max(1.0, float(np.median(grid[max(0, i - 10) : i + 11, j])))
    out = []
    for name, rows, columns, far, least, alpha in (("2x2", 1, 20, 150, 20, 0.005), ("2x0.2", 1, 2, 90, 6, 0.001), ("0.3x0.3", 1, 3, 90, 6, 0.001)):
        hits = []
        for i in range(n):
            need = max(2, columns // 3, poisson_critical(float(grid[i].sum()) * columns / m, alpha))
            for j in range(m - columns + 1):
                hot = int((over[i, j : j + columns] >= 2).sum())
                beside = [over[a:b, j : j + columns] for a, b in ((max(0, i - 2), i), (i + rows, min(n, i + 3))) if a < b]
                if hot / columns >= 0.6 and grid[i, j : j + columns].sum() >= need and all((v >= 2).mean() < 0.6 for v in beside):
                    hits.append(((i + 0.5) * 2.0, (j + columns / 2) * 0.1 - 3.5, hot))
        kept = []
        for d, y, hot in sorted(hits, key=lambda h: -h[2]):
            if 15 <= d <= far and hot >= least and not any(abs(d - a) <= 2.0 and abs(y - b) <= 0.4 for a, b, _ in kept):
                kept.append((d, y, hot))
        out += [(name, *k) for k in kept]
    for i in range(7, 30):
        need = max(3, poisson_critical(float(grid[i].sum()) / m, 0.001))
        for j in range(m):
            if over[i, j] >= 4 and grid[i, j] >= need and np.median([over[i - 1, j], over[i + 1, j]]) < 3:
                out.append(("0.05", (i + 0.5) * 2.0, (j + 0.5) * 0.1 - 3.5, 1))
    return out


def test_excess_against_plain_rules(spark):
    rng = np.random.default_rng(8)
    for k in range(3):
        grid = rng.poisson(1.5, (90, 70)).astype(float)
        grid[20 + k, 30:52] += 20
        grid[40:44, 5:30] += 30
        grid[25, 60] += 40
        grid[10, 2:4] += 25
        assert lidar.excess_boxes(grid) == plain_excess(grid) and {b[0] for b in lidar.excess_boxes(grid)} == {"2x2", "0.05"}
    from rangeforge.operators import grids
    from rangeforge.plans.detector_queries import occupancy_boxes, points, signal
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in occupancy_boxes(spark, sf).collect():
        got.setdefault(r.bag, []).append((r.box, r.D, r.y, r.hot))
    box = signal(spark, sf).select((F.col("bag") % 4).alias("bag"), (30 + F.col("d") / 1000).alias("f"), ((F.col("event_id") % 20) * 0.1 - 0.95).alias("lat"))
    cells = grids.occupancy(points(spark, sf).select("bag", "f", "lat").unionByName(box), 2.0, 0.1, 180.0, 3.5, ["bag"]).collect()
    for bag in range(4):
        grid = np.zeros((90, 70))
        for r in cells:
            if r.bag == bag:
                grid[r.d_bin, r.y_bin] += r.n
        assert sorted(got[bag]) == sorted(plain_excess(grid)) and any(b[0] == "2x2" for b in got[bag])


def test_rails_are_followed(spark):
    """The rail track over frames in order, against a plain loop that looks near the last real level."""
    from rangeforge.plans.detector_queries import frames_with_rails, rail_centres

    sf = "/root/testdata/sf0.001"
    frames = {}
    for r in frames_with_rails(spark, sf).collect():
        frames.setdefault((r.bag, r.frame_idx), []).append((r.x, r.d, r.z))
    want, real = {}, {}
    for bag, n in sorted(frames):
        last = next((real[bag, k][1] for k in range(n - 1, n - 8, -1) if (bag, k) in real), None)
        found = lidar.detect_rails(*np.array(frames[bag, n]).T, last)
        if found:
            real[bag, n] = (found[0], last if last is not None and abs(found[1] - last) > 0.25 else found[1])
        near = [real[bag, k] for k in range(n - 6, n + 1) if (bag, k) in real]
        want[bag, n] = (float(np.median([v[0] for v in near])), float(np.median([v[1] for v in near])), bool(found)) if near else (0.0, -1.075, False)
    got = {(r.bag, r.frame_idx): (r.xc, r.zr, r.found) for r in rail_centres(spark, sf).collect()}
    assert got == want
    # The track climbs by half a metre: only a moving window follows it.
    assert max(v[1] for v in got.values()) > -0.75 and sum(v[2] for v in got.values()) > 100


def test_box_growth_fit():
    rng = np.random.default_rng(2)
    n = 60000
    f = rng.uniform(5, 70, n)
    y, z = rng.uniform(-0.11, 0.11, n) * f, rng.uniform(-0.03, 0.04, n) * f
    hidden = (np.abs(y / f) < 0.02) & (np.abs(z / f) < 0.02) & (f > 32)
    bf = rng.uniform(31.1, 31.9, 4000)
    boxes = lidar.shadow_boxes(*(np.concatenate([v[~hidden], w]) for v, w in ((f, bf), (y, rng.uniform(-0.02, 0.02, 4000) * bf), (z, rng.uniform(-0.02, 0.02, 4000) * bf))), np.arange(10.0, 66, 1), width=0.004, a_max=0.12, b_lo=-0.06, b_hi=0.06)
    box = boxes[0]
    assert box["growth_ok"] == (abs(box["growth"] - box["d2"]) / max(1.0, box["d2"]) <= 0.25) and box["growth"] > 0


def test_line_frames_are_dealt_before_their_pixels(spark):
    """Frames lie in many tasks, and pixels are grouped where they were made: one exchange, that of the frames."""
    from rangeforge.plans import detector_queries

    found = detector_queries._measured(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    pixels = detector_queries.frames_with_lines(spark, "/root/testdata/sf0.001")
    assert pixels.rdd.getNumPartitions() >= 4 and pixels.groupBy("bag", "grp", "x", "y").count().count() == pixels.distinct().count()


def test_frames_of_lines_come_as_a_row_each(spark):
    """Pixels are made as arrays and measured where they are: no row for each pixel, and none is sorted."""
    from rangeforge.plans import detector_queries

    plan = detector_queries._measured(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Sort" not in plan and "MapInPandas" in plan


def test_packed_frames_are_measured_as_rows_of_pixels_are(spark, grid, maps):
    """Pixels off the frame and null ones count for nothing; frames without others give no row."""
    gray = scene(grid, 4.0)
    y, x = (v.tolist() for v in np.nonzero(gray))
    frames = {"plain": (x, y), "off": ([-3, 1280, None, 5, *x], [5, 5, 5, 720, *y]), "empty": ([], []), "outside": ([2000], [10]), "none": (None, None)}
    rows = [(name, own[0], own[1], None if own[0] is None else [220] * len(own[0])) for name, own in frames.items()]
    found = {r["name"]: r[1:] for r in camera.packed_measurements(spark.createDataFrame(rows, "name string, x array<int>, y array<int>, gray array<int>"), ["name"], maps).collect()}
    assert set(found) == {"plain", "off"} and found["plain"] == found["off"] == tuple(measured(spark, maps, {"m": gray})["m"][1:])


def test_a_segment_is_looked_up_once(grid, maps, monkeypatch):
    """All segments of a fan at once: once to tell the fans, once for their distances."""
    seen, plain = [], camera.FanMap.fit_distances
    monkeypatch.setattr(camera.FanMap, "fit_distances", lambda self, lines: (seen.append(len(lines)), plain(self, lines))[1])
    camera.measure_frame(scene(grid, 4.0), maps)
    assert 0 < len(seen) <= 5


def test_many_lines_are_looked_up_at_once(maps):
    t = np.linspace(0, 6, 50)
    lines = np.stack([np.cos(t), np.sin(t), np.linspace(-400, 100, 50)], axis=1)
    for own in maps.values():
        assert [tuple(v) for v in zip(*own.fit_distances(lines), strict=True)] == [own.fit_distance(v) for v in lines]


def test_boxes_of_places_that_stand_for_many():
    """Repeated points give the boxes of their places with numbers."""
    rng = np.random.default_rng(4)
    for n in (10, 11, 57, 400):
        v, many = np.round(rng.normal(size=n), 2), rng.integers(1, 9, n)
        q = [0.5, 1, 37.3, 50, 99, 99.5]
        assert lidar.percentiles(v, many, q) == np.percentile(np.repeat(v, many), q).tolist()
    f = rng.uniform(5, 70, 60_000)
    a, b = rng.uniform(-0.11, 0.11, len(f)), rng.uniform(-0.03, 0.04, len(f))
    hidden = (np.abs(a) < 0.02) & (np.abs(b) < 0.02) & (f > 32)
    f, a, b = (np.concatenate([v[~hidden], w]) for v, w in ((f, rng.uniform(31.1, 31.9, 4000)), (a, rng.uniform(-0.02, 0.02, 4000)), (b, rng.uniform(-0.02, 0.02, 4000))))
    many = rng.integers(1, 4, len(f))
    rules = {"width": 0.004, "a_max": 0.12, "b_lo": -0.06, "b_hi": 0.06}
    few = lidar.shadow_boxes(f, a * f, b * f, np.arange(10.0, 66, 1), many=many, **rules)
    every = lidar.shadow_boxes(*(np.repeat(v, many) for v in (f, a * f, b * f)), np.arange(10.0, 66, 1), **rules)
    assert few == every and few


def test_rail_track_takes_points_of_one_place_as_one_row(spark):
    rng = np.random.default_rng(5)
    one = [(1, k // 80, float((-0.76, 0.76)[k % 2]), 2.5 + k % 80 * 0.1, -1.07 + float(rng.integers(-2, 3)) / 100) for k in range(320)]
    points = spark.createDataFrame(one * 3, "bag long, frame_idx long, x double, d double, z double")
    got = lidar.rail_track(points)
    assert "__many" in got._jdf.queryExecution().executedPlan().toString()
    track = lidar.RailTrack(lidar.SliceConfig().rail_height)
    for r in got.orderBy("frame_idx").collect():
        xyz = np.array([p[2:] for p in one * 3 if p[1] == r["frame_idx"]])
        assert (r["xc"], r["zr"], r["found"]) == pytest.approx(track.step(r["frame_idx"], *xyz.T))
