"""Streams against the batch operators, with frames dealt over several batches that come in any order."""

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rangeforge.config import ShadowConfig
from rangeforge.operators import aggregates, folds, grids
from rangeforge.operators import windows as w
from rangeforge.sources.driver import signal
from rangeforge.streaming import online
from rangeforge.plans.grid_queries import states

SF = "/root/testdata/sf0.001"
END = -1  # a recording of its own, far later than all others, that moves the watermark past them
FIRST, LATER = 10**17, 10**18  # nanoseconds
ALL = "30 days"


def play(spark, rows, schema, tmp_path, build, batches=3, seed=0, end=True):
    """The stream's rows and its query. Rows are dealt at random over one file a batch; all files have the same time."""
    folder = tmp_path / "in"
    folder.mkdir()
    rng, files = random.Random(seed), [[] for _ in range(batches)]
    for r in rows:
        files[rng.randrange(batches)].append({"ts_ns": FIRST + r["frame_idx"] * 10**8, **r})
    for k, own in enumerate(files):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, own)))
        os.utime(folder / f"{k}.json", (10**9, 10**9))
    if end:
        blank = {k: [] if isinstance(v, list) else None for k, v in rows[0].items()}
        (folder / "z.json").write_text(json.dumps({**blank, "bag": END, "frame_idx": 0, "ts_ns": LATER}))
        os.utime(folder / "z.json", (2 * 10**9, 2 * 10**9))
    name = f"out_{tmp_path.name}".replace("-", "_")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    return [r for r in spark.table(name).collect() if r["bag"] != END], q


def timed_states(spark):
    return states(spark, SF).withColumn("ts_ns", F.col("frame_idx") * 10**8)


@pytest.mark.parametrize("seed", [1, 2])
def test_consensus(spark, tmp_path, seed):
    st = timed_states(spark)
    packed = online.pack_frames(st)
    rows = [{"bag": r.bag, "frame_idx": r.frame_idx, "lit": list(r.lit)} for r in packed.collect()]
    got, query = play(spark, rows, "bag long, ts_ns long, frame_idx long, lit array<long>", tmp_path, lambda s: online.consensus_stream(s, late=ALL), seed=seed)
    reference = w.sliding_consensus(st, "bag", 5, 0.5, current=False)
    frames = st.select("bag", "frame_idx").distinct().withColumn("seq", F.row_number().over(w.Window.partitionBy("bag").orderBy("frame_idx"))).where("seq >= 6")
    want = w.shadows_and_objects(st.join(frames, ["bag", "frame_idx"]), reference, ["bag", "frame_idx"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    assert online.late_frames(query) == 0


def test_late_frames_are_counted(spark, tmp_path):
    """A batch that comes after the watermark has passed its frames: they are dropped, and the query says how many."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, frames in enumerate(([10, 11, 12], [13, 20], [1, 2, 14], [30])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"bag": 1, "ts_ns": n * 10**9, "frame_idx": n, "d": float(n)}) for n in frames))
        os.utime(folder / f"{k}.json", (10**9 + 100 * k, 10**9 + 100 * k))
    stream = online.ema_stream(spark.readStream.schema("bag long, ts_ns long, frame_idx long, d double").option("maxFilesPerTrigger", 1).json(str(folder)), keep=0.0, late="7 seconds")
    q = stream.writeStream.format("memory").queryName("late_frames").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    assert [tuple(r) for r in spark.table("late_frames").orderBy("frame_idx").collect()] == [(1, n, float(n)) for n in (10, 11, 12, 13, 14, 20)]
    assert online.late_frames(q) == 2


@pytest.mark.parametrize("kind", ["track", "ema", "held"])
def test_trackers(spark, tmp_path, kind):
    e = signal(spark, SF).select("bag", "frame_idx", F.when(F.col("fam") != "error", F.col("d")).alias("d"), F.col("theta").cast("double").alias("theta"), "fam")
    rows = [r.asDict() for r in e.collect()]
    schema = "bag long, ts_ns long, frame_idx long, d double, theta double, fam string"
    if kind == "track":
        got, _ = play(spark, rows, schema, tmp_path, lambda s: online.tracker_stream(s, gate_d=120.0, gate_theta=90.0, late=ALL))
        want = folds.track_nearest(e, ["bag"], "frame_idx", "d", "theta", gate_d=120.0, gate_theta=90.0).select("bag", "frame_idx", "track_d", "track_theta", "streak", "reported").collect()
    elif kind == "ema":
        got, _ = play(spark, rows, schema, tmp_path, lambda s: online.ema_stream(s, patience=1, late=ALL))
        want = w.ema_with_reset(e, "bag", "frame_idx", "d", F.col("fam") == "error", patience=1).collect()
    else:
        got, _ = play(spark, rows, schema, tmp_path, lambda s: online.held_stream(s, late=ALL))
        by = {(r["bag"], r["frame_idx"]): r["d"] for r in rows}
        want = [(bag, n, by[bag, n - n % 2], n % 2 == 0) for bag, n in by]
    rounded = lambda rows: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert rounded(got) == rounded(want)


def test_tracker_starts_anew_after_boot(spark, tmp_path):
    rows = [{"bag": 1, "frame_idx": k, "d": 5.0, "theta": 10.0} for k in range(9)]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long, d double, theta double", tmp_path, lambda s: online.tracker_stream(s, reset_at=5, late="1 second"))
    assert [(r.frame_idx, r.streak, r.reported) for r in sorted(got, key=lambda r: r.frame_idx)] == [(k, k % 5 + 1, k % 5 >= 2) for k in range(9)]


def test_boot_mask(spark, tmp_path):
    rows = [{"bag": 1, "frame_idx": k, "lit": [5 << 20 | 7, *([9] if k % 5 == 0 else [])]} for k in range(40)]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long, lit array<long>", tmp_path, lambda s: online.boot_mask_stream(s, (20, 8), boot=20, late=ALL))
    assert sorted(map(tuple, got)) == [(1, u, v) for u in (4, 5, 6) for v in (6, 7)]


def test_persistence(spark, tmp_path):
    box = lambda x, y: {"x_lo": x, "x_hi": x + 5, "y_lo": y, "y_hi": y + 5}
    rows = [{"bag": 1, "frame_idx": k, "boxes": [box(10.0 * k, 0.0), *([box(500.0, 500.0)] if k != 3 else [])]} for k in range(7)]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long, boxes array<struct<x_lo:double,x_hi:double,y_lo:double,y_hi:double>>", tmp_path, lambda s: online.persistence_stream(s, grow=6.0, late=ALL))
    assert sorted(map(tuple, got)) == [(1, 2, 1), (1, 6, 1)]


CONFIG = ShadowConfig(d0=20.0, res=0.5, window=3, prime=4, buffer=6)


def scene(n):
    rng = np.random.default_rng(n)
    xyz = np.stack([rng.uniform(-3, 3, 900), -rng.uniform(1, 60, 900), rng.uniform(-1.5, 1.5, 900)])
    return [[round(v, 3) for v in axis.tolist()] for axis in xyz]


def test_priming(spark, tmp_path):
    """Axes, grid and states of the primed stream against the batch operators."""
    frames = {n: scene(n) for n in range(8)}
    rows = [{"bag": 1, "frame_idx": n, "x": x, "y": y, "z": z} for n, (x, y, z) in frames.items()]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long, x array<double>, y array<double>, z array<double>", tmp_path, lambda s: online.primed_consensus_stream(s, CONFIG, late=ALL))
    sample = np.concatenate([np.array(frames[n]).T for n in range(4)])
    axes, grid = online.primed_geometry(sample, CONFIG)
    names = "xyz"
    points = spark.createDataFrame(pd.DataFrame(sample, columns=list(names)))
    found = aggregates.detect_axes(points, list(names)).first()
    assert (names[axes[0]], axes[1], names[axes[2]], names[axes[3]]) == tuple(found) == ("y", -1, "x", "z")
    e = grids.extent(points.selectExpr("-y AS f", "x AS lat", "z AS ver"), CONFIG.d0, CONFIG.margin).first()
    assert np.allclose([grid.u_lo, grid.u_hi, grid.v_lo, grid.v_hi], [e["u_lo"], e["u_hi"], e["v_lo"], e["v_hi"]])
    whole = spark.createDataFrame(pd.DataFrame([(n, *p) for n, f in frames.items() for p in zip(*f, strict=True)], columns=["frame_idx", *names])).selectExpr("frame_idx", "-y AS f", "x AS lat", "z AS ver")
    lit = {n: set() for n in frames}
    for r in grids.z_buffer(grids.plane_cells(whole, CONFIG.d0, grid), ["frame_idx"], CONFIG.d0).where("st = 1").collect():
        lit[r.frame_idx].add((r.iu, r.iv))
    want = set()
    for n in range(3, 8):
        ring = [lit[k] for k in range(n - 2, n + 1)]
        reference = {c for c in set().union(*ring) if sum(c in r for r in ring) / 3 > 0.5}
        want |= {(1, n, *c, "shadow") for c in reference - lit[n]} | {(1, n, *c, "object") for c in lit[n] - reference}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_windowed_counts(spark, tmp_path):
    rows = [{"bag": k % 2, "frame_idx": k, "ts_ns": k * 10**9} for k in range(40)]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long", tmp_path, lambda s: online.windowed_counts(s.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))), late=ALL))
    assert sorted((r.bag, r.window.start.second // 10 + 6 * r.window.start.minute, r.frames) for r in got) == [(b, k, 5) for b in range(2) for k in range(4)]


def test_sinks_and_summary(spark, tmp_path):
    rows = [{"bag": 1, "frame_idx": k, "lit": [1, 2] if k != 7 else [3]} for k in range(9)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"ts_ns": r["frame_idx"] * 10**9, **r}) for r in [*rows, {"bag": END, "frame_idx": 10**6, "lit": []}]))
    stream = online.consensus_stream(spark.readStream.schema("bag long, ts_ns long, frame_idx long, lit array<long>").json(str(folder)))
    for kind in ("parquet", "csv"):
        online.write_batches(stream, str(tmp_path / kind), str(tmp_path / f"ck_{kind}"), kind=kind, once=True).awaitTermination(300)
        written = spark.read.schema("bag long, frame_idx long, iu int, iv int, kind string").option("header", "true").format(kind).load(str(tmp_path / kind))
        assert sorted(map(tuple, online.summary(written).collect())) == [(1, "object", 1, 1), (1, "shadow", 1, 2)]


def test_frames_are_taken_a_few_at_a_time(spark, tmp_path):
    """A long recording is never stepped through as a whole."""

    class Sizes(online.Ema):
        gives = "frame_idx long, ema double"

        def step(self, frames):
            yield pd.DataFrame({"frame_idx": [n for n, _ in frames], "ema": float(len(frames))})

    rows = [{"bag": 1, "frame_idx": k, "d": 1.0} for k in range(1500)]
    got, _ = play(spark, rows, "bag long, ts_ns long, frame_idx long, d double", tmp_path, lambda s: online._ordered(s, Sizes(0.7, 2), ALL))
    assert sorted(r.frame_idx for r in got) == list(range(1500))
    assert max(r.ema for r in got) < online.AT_ONCE + 101


class Kept(dict):
    """State in a plain dict, with the number of writes."""

    writes = 0

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v

    def update(self, v):
        self[()] = v

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    removeKey, getValue, iterator = dict.pop, dict.get, lambda self: iter(list(self.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getListState = getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class Seen(online.Ordered):
    takes, gives = "d double, lit array<long>", "frame_idx long, d double, lit array<long>"

    def step(self, frames):
        assert len(frames) <= online.AT_ONCE
        yield pd.DataFrame([(n, d, tuple(lit)) for n, d, lit in frames], columns=["frame_idx", "d", "lit"])


@pytest.mark.parametrize("sizes", [(1 << 25, 1 << 18, 64), (4000, 600, 3), (500, 1, 2)])
def test_frames_are_merged_from_runs_of_any_size(sizes):
    """Frames in any order, some twice, with a watermark that moves: each comes out once, in order, as soon as it is ready, and nothing is left."""
    rng = np.random.default_rng(3)
    seen, handle = Seen(), Handle()
    seen.SORTED, seen.BLOCK, seen.MERGED = sizes
    seen.init(handle)
    want, got, done = {}, [], -1
    for batch in range(14):
        mark = 50 * batch - 200 if batch < 13 else 10**6  # milliseconds
        n = rng.integers(max(done + 1, 0), max(done + 400, 400), 120)
        came = pd.DataFrame({"ts_ns": n // 2 * 2 * 10**6 + 999_999, "frame_idx": n, "d": rng.random(120), "lit": [list(range(k % 5)) for k in n]})
        want |= {(ts, n): (n, d, tuple(lit)) for ts, n, d, lit in came.itertuples(index=False)}
        out = pd.concat([*seen.handleInputRows((7,), iter([came[:70], came[70:]]), Mark(mark)), pd.DataFrame({"bag": []})])
        ready = sorted(k for k in want if k[0] // 10**6 <= mark)
        assert [tuple(r) for r in out[["frame_idx", "d", "lit"]].itertuples(index=False)] == [want.pop(k) for k in ready] if ready else not len(out)
        got += ready
        done = max(done, mark)
        if want:
            assert handle.timers[-1] == min(want)[0] // 10**6
    assert len(got) > 300 and not want and not handle.states["runs"] and not handle.states["blocks"]


def test_frames_in_any_order_are_held_in_few_pieces():
    """A recording's frames that come in random order are not held in a piece each, nor in one for each stretch of time."""
    held, handle = online.Held(2), Handle()
    held.init(handle)
    n = np.random.default_rng(0).permutation(60000)
    parts = (pd.DataFrame({"ts_ns": FIRST + k * 10**8, "frame_idx": k, "d": k * 1.0}) for k in np.split(n, 6))
    assert not list(held.handleInputRows((1,), parts, Mark(0)))
    assert sum(s.writes for s in handle.states.values()) <= 20
    steps = list(held.handleExpiredTimer((1,), Mark(10**15), None))
    assert max(map(len, steps)) <= online.AT_ONCE < 60000
    out = pd.concat(steps)
    assert out["frame_idx"].tolist() == list(range(60000)) and out["d"].tolist() == [float(k - k % 2) for k in range(60000)]


def test_bags_grow_by_new_messages(spark, monkeypatch):
    """Each point is made into a message once, though bags are written four times."""
    from rangeforge.plans import stream_queries
    from rangeforge.sources import pointcloud2

    seen, encode = spark.sparkContext.accumulator(0), pointcloud2.encode_frames

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(pointcloud2, "encode_frames", lambda points: encode(points.mapInArrow(counted, points.schema)))
    n = stream_queries.stream_bags(spark, SF).count()
    assert n and seen.value == spark.read.parquet(f"{SF}/lineitem.parquet").count()
