"""Codecs and sources: round trips, odd layouts, errors."""

import os
import sqlite3

import numpy as np
import pytest

from rangeforge.sources import calibration, las, pointcloud2, rosbag, tables


def cloud(n, seed=0):
    rng = np.random.default_rng(seed)
    return {"x": rng.normal(0, 20, n).astype("f4"), "y": rng.normal(0, 20, n).astype("f4"), "z": rng.normal(0, 2, n).astype("f4"), "intensity": rng.integers(0, 255, n).astype("f4"), "ring": rng.integers(0, 64, n).astype("u1")}


def make_bag(path, legacy=False, frames=7):
    db = sqlite3.connect(path)
    if legacy:
        db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic TEXT, ts INTEGER, blob BLOB)")
    else:
        db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT)")
        db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?)", [(1, "/points"), (2, "/imu")])
    for k in range(frames):
        topic = ("/points" if k % 3 else "/imu") if legacy else (9 if k == 6 else 1 if k % 3 else 2)
        db.execute("INSERT INTO messages VALUES (?, ?, ?, ?)", (k + 1, topic, (frames - k) * 10**8, pointcloud2.encode_cloud(cloud(5 + k, k), stamp_ns=k)))
    db.commit()
    db.close()


@pytest.mark.parametrize(("frame_id", "start"), [("eleven_char", 196), ("twelve_chars", 200)])
def test_header_of_known_length(frame_id, start):
    message = pointcloud2.encode_cloud(cloud(4), frame_id, fields=(*pointcloud2.FIELDS_26, ("timestamp", 18, 8)))
    assert pointcloud2.read_layout(message).start == start


def test_round_trip(spark):
    data = [("a", k, k * 10, pointcloud2.encode_cloud(cloud(3 + k, k))) for k in range(4)] + [("a", 9, 0, None)]
    frames = spark.createDataFrame(data, "bag string, frame_idx long, ts_ns long, data binary")
    got = pointcloud2.decode_frames(frames).orderBy("frame_idx", "pt_idx").collect()
    assert len(got) == 3 + 4 + 5 + 6
    want = cloud(4, 1)
    rows = [r for r in got if r.frame_idx == 1]
    for name in ("x", "y", "z", "intensity", "ring"):
        assert [getattr(r, name) for r in rows] == pytest.approx(list(want[name]))


def test_encoded_pieces(spark):
    """Messages hold their points in order whatever task read them; pieces of frames are shuffled, not points."""
    rng = np.random.default_rng(5)
    data = []
    for bag, frame in (("a", 0), ("a", 7), ("b", 0), (None, None)):
        p = cloud(900, len(data))
        data += [(bag, frame, 5 + k, k, *(float(p[c][k]) for c in ("x", "y", "z", "intensity")), int(p["ring"][k])) for k in range(900)]
    rows = [data[k] for k in rng.permutation(len(data))]
    points = spark.createDataFrame(rows, "bag string, frame_idx long, ts_ns long, pt_idx int, x double, y double, z double, intensity double, ring int").repartition(5)
    messages = pointcloud2.encode_frames(points, frame_id="s")
    got = {(r.bag, r.frame_idx): r for r in messages.collect()}
    assert len(got) == 4
    for k, key in enumerate((("a", 0), ("a", 7), ("b", 0), (None, None))):
        want = pointcloud2.encode_cloud(cloud(900, 900 * k), "s", 5, fields=(*pointcloud2.FIELDS_26, ("timestamp", 18, 8)))
        assert got[key].ts_ns == 5 and bytes(got[key].data) == want
    plan = messages._jdf.queryExecution().optimizedPlan().toString().splitlines()
    shuffle = next(k for k, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert "MapInArrow" in plan[shuffle + 1] and "body" in plan[shuffle + 1]


def test_missing_fields():
    fields = (("x", 0, 7), ("y", 4, 7), ("z", 8, 7))
    message = pointcloud2.encode_cloud(cloud(3), fields=fields, step=12)
    layout = pointcloud2.read_layout(message)
    assert pointcloud2.columns_of(message, layout, ("x", "intensity"))["intensity"] is None
    with pytest.raises(ValueError, match="no field"):
        pointcloud2.read_layout(pointcloud2.encode_cloud({"x": np.zeros(1)}, fields=(("x", 0, 7),), step=4))
    with pytest.raises(ValueError, match="type 9"):
        pointcloud2.read_layout(_patched(message))
    assert pointcloud2.fixed_layout(b"\0" * 199).count == 0


def _patched(message):
    at = message.index(b"x\0") + 8
    return message[:at] + b"\x09" + message[at + 1 :]


@pytest.mark.parametrize("legacy", [False, True])
def test_bag_source(spark, tmp_path, legacy):
    os.mkdir(tmp_path / "run")
    make_bag(str(tmp_path / "run" / "b.db3"), legacy)
    rosbag.register(spark)
    load = lambda **o: spark.read.format("rosbag").options(rowsPerPartition="3", **o).load(str(tmp_path))
    rows = load().orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == list(range(7)) and {r.bag for r in rows} == {"run"}
    assert rows[6].topic == ("/imu" if legacy else "") and rows[1].topic == "/points"
    assert [r.ts_ns for r in load(orderBy="timestamp").orderBy("frame_idx").collect()] == sorted(r.ts_ns for r in rows)
    assert load().where("topic = '/points' AND ts_ns > 300000000").count() == sum(r.topic == "/points" and r.ts_ns > 3 * 10**8 for r in rows)
    assert load(bags="nothing").count() == 0 and load(bags="run,x").count() == 7
    assert pointcloud2.decode_frames(load()).count() == sum(5 + k for k in range(7))


def test_bag_errors(tmp_path):
    empty = tmp_path / "e.db3"
    empty.touch()
    with pytest.raises(ValueError, match="empty"):
        rosbag.open_bag(str(empty))
    for sql, text in (("CREATE TABLE other(a)", "no table"), ("CREATE TABLE messages(id, what)", "known layout")):
        path = str(tmp_path / f"{len(sql)}.db3")
        db = sqlite3.connect(path)
        db.execute(sql)
        db.commit()
        with pytest.raises(ValueError, match=text):
            rosbag.sniff(db, path)


def test_las_round_trip(spark, tmp_path):
    p = cloud(50)
    (tmp_path / "one.las").write_bytes(las.write_bytes(p["x"], p["y"], p["z"], [np.nan, 70000, -1] + [5] * 47, p["ring"], np.full(50, 3)))
    rows = las.read_las(spark, str(tmp_path)).orderBy("pt_idx").collect()
    assert [r.x for r in rows] == pytest.approx(list(p["x"]), abs=0.00051)
    assert [r.intensity for r in rows[:4]] == [0, 65535, 0, 5] and {r.source_id for r in rows} == {3} and rows[0].bag == "one"
    with pytest.raises(ValueError, match="no LAS"):
        las.read_bytes(b"nope" * 100)


def frames_of(spark, n=40, frames=3):
    p = cloud(n * frames)
    rows = [("a", k % frames, k, *(float(p[c][k]) for c in ("x", "y", "z", "intensity", "ring"))) for k in range(n * frames)]
    rows[5] = (*rows[5][:3], float("nan"), *rows[5][4:])
    rows.append(("lost", 0, 0, None, 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "bag string, frame_idx long, pt_idx long, x double, y double, z double, intensity double, ring double")


def test_las_format(spark, tmp_path):
    """What is written comes back in any cut; points without a place are left out, a frame of none is an empty file."""
    out = str(tmp_path / "las")
    points = frames_of(spark)
    las.write_las(points, out)
    assert sorted(os.listdir(out)) == ["a_0.las", "a_1.las", "a_2.las", "lost_0.las"]
    want = sorted((f"a_{r.frame_idx}", round(r.x, 3)) for r in points.where("x IS NOT NULL AND NOT isnan(x)").collect())
    for size in ("100", "227", "333", "33554432"):
        load = spark.read.format("las").option("bytesPerPartition", size).load(out)
        got = sorted((r.bag, round(r.x, 3)) for r in load.collect())
        assert got == want and sorted(set(load.where("bag = 'a_1'").select("pt_idx").toPandas()["pt_idx"])) == list(range(sum(b == "a_1" for b, _ in want)))
    assert load.where("bag IN ('a_0', 'lost_0')").count() == 40 - (5 % 3 == 0)
    narrow = spark.read.format("las").schema("x double, bag string").load(f"{out}/a_2.las")
    assert narrow.columns == ["x", "bag"] and narrow.count() == sum(b == "a_2" for b, _ in want)
    with pytest.raises(Exception, match="no column"):
        spark.read.format("las").schema("colour string").load(out).collect()
    las.write_las(points.where("frame_idx = 1"), out, "overwrite")
    assert os.listdir(out) == ["a_1.las"]
    las.write_las(points.limit(0), str(tmp_path / "none"))
    assert las.read_las(spark, str(tmp_path / "none")).count() == 0
    whole = (tmp_path / "las" / "a_1.las").read_bytes()
    (tmp_path / "las" / "a_1.las").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends early"):
        las.read_las(spark, out).count()


def test_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails, or a frame in two places, leaves neither files nor parts; what was there before stays."""
    from pyspark.sql import functions as F

    out = str(tmp_path / "las")
    las.write_las(frames_of(spark), out)
    before = {name: (tmp_path / "las" / name).read_bytes() for name in os.listdir(out)}
    rows = frames_of(spark).repartition(4, "frame_idx").select("bag", "frame_idx", "x", "y", "z", "intensity", F.when(F.col("frame_idx") < 2, F.col("ring")).otherwise(F.raise_error(F.lit("lost task")).cast("double")).alias("ring"))
    with pytest.raises(Exception, match="lost task"):
        rows.write.format("las").mode("overwrite").save(out)
    with pytest.raises(Exception, match="several places"):
        frames_of(spark).repartition(5).write.format("las").mode("append").save(out)
    with pytest.raises(Exception, match="need the columns"):
        frames_of(spark).drop("ring").write.format("las").mode("append").save(out)
    assert {name: (tmp_path / "las" / name).read_bytes() for name in os.listdir(out)} == before


def test_bag_format(spark, tmp_path):
    data = [("b", t, k, 100 - k, bytes([k])) for k, t in enumerate(["/x", "/y", None, "/x"])] + [("c", "/x", 0, None, None)]
    messages = spark.createDataFrame(data, "bag string, topic string, frame_idx long, ts_ns long, data binary")
    assert [os.path.basename(p) for p in rosbag.write_bags(messages.orderBy(messages.ts_ns), str(tmp_path))] == ["b.db3", "c.db3"]
    got = spark.read.format("rosbag").load(str(tmp_path)).orderBy("bag", "frame_idx").collect()
    assert [(r.bag, r.topic, r.frame_idx, r.ts_ns, r.data) for r in got] == [(b, t or "", k, ts, d) for b, t, k, ts, d in data]
    archives = tables.pack_archives(spark, [str(tmp_path / b / f"{b}.db3") for b in "bc"], str(tmp_path / "packed"))
    assert [os.path.basename(a) for a in archives] == ["b.tar.zst", "c.tar.zst"]
    tables.unpack_archives(spark, archives, str(tmp_path / "un"))
    assert spark.read.format("rosbag").load(str(tmp_path / "un")).count() == 5


def test_calibration_round_trip(spark, tmp_path):
    nodes = calibration.make_nodes(spark)
    calibration.write_nodes(nodes, str(tmp_path / "c"))
    back = calibration.read_nodes(spark, str(tmp_path / "c"))
    key = lambda df: sorted(tuple(r) for r in df.select("fan", "vertical", "direction", "i", "d", "x0", "m").collect())
    assert key(back) == key(nodes)
    (tmp_path / "none.json").write_text('{"version": 1}')
    assert calibration.read_nodes(spark, str(tmp_path / "none.json")).count() == 0


def test_runs_and_masks(spark, tmp_path):
    for run in ("r1", "r2"):
        os.mkdir(tmp_path / run)
        (tmp_path / run / "o.csv").write_text("chunk,size\n1,2.5\n")
    assert sorted(r.scenario for r in tables.read_runs(spark, str(tmp_path), "chunk int, size double").collect()) == ["r1", "r2"]
    assert tables.load_mask(spark, str(tmp_path / "mask")) is None
    tables.save_mask(spark.range(3), str(tmp_path / "mask"))
    assert tables.load_mask(spark, str(tmp_path / "mask")).count() == 3
    tables.write_csv(spark.createDataFrame([(1, 2.0)], "a int, b double"), str(tmp_path / "csv"), {"b": 3})
    assert [r.b for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["2.000"]
    with pytest.raises(ValueError, match="expected"):
        tables.load_any(spark, "x.bin")


def test_sql_functions(spark):
    from rangeforge.functions import registered
    from rangeforge.operators.fits import poisson_critical

    registered.register(spark)
    spark.createDataFrame([(1, pointcloud2.encode_cloud(cloud(4))), (2, None)], "k int, data binary").createOrReplaceTempView("messages")
    assert [r.pt_idx for r in spark.sql("SELECT pt_idx FROM messages, LATERAL decode_pointcloud2(data) ORDER BY pt_idx").collect()] == [0, 1, 2, 3]
    row = spark.sql("SELECT poisson_critical(2.5D, 0.01D) AS n, polar_range(3D, 4D) AS r, bearing_about(0D, -1D, 0D, 0D) AS b").first()
    assert tuple(row) == (poisson_critical(2.5, 0.01), 5.0, 270.0)


def test_growing_bags(tmp_path):
    """Offsets by bag and id: only what was added comes, batches repeat alike, in any cut; odd files wait."""
    reader = rosbag.RosbagStreamReader(str(tmp_path / "bags"), per_partition=3)
    assert reader.latestOffset() == reader.initialOffset() == {} and reader.partitions({}, {}) == []

    def add(bag, ids):
        os.makedirs(tmp_path / "bags" / bag, exist_ok=True)
        path = str(tmp_path / "bags" / bag / "a.db3")
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE IF NOT EXISTS messages(id INTEGER PRIMARY KEY, topic TEXT, timestamp INTEGER, data BLOB)")
            db.executemany("INSERT INTO messages VALUES (?, '/p', ?, ?)", [(k, 1000 - k, None if k == 4 else bytes([k])) for k in ids])
        db.close()
        return path

    def batch(start, end):
        parts = reader.partitions(start, end)
        return [(r["bag"], r["frame_idx"], r["ts_ns"], r["data"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]

    one = add("one", [1, 2, 4, 9])
    first = reader.latestOffset()
    assert first == {one: 9}
    taken = batch({}, first)
    assert taken == [("one", k, 1000 - i, None if i == 4 else bytes([i])) for k, i in enumerate([1, 2, 4, 9])]
    add("one", [10, 30])
    two = add("two", [5])
    (tmp_path / "bags" / "empty").mkdir()
    (tmp_path / "bags" / "empty" / "a.db3").touch()
    second = reader.latestOffset()
    assert second == {one: 30, two: 5}
    assert batch({}, first) == taken
    assert batch(first, second) == [("one", 4, 990, bytes([10])), ("one", 5, 970, bytes([30])), ("two", 0, 995, bytes([5]))]
    assert batch(second, second) == []
    with pytest.raises(ValueError, match="by id"):
        rosbag.RosbagSource({"path": "x", "orderBy": "timestamp"}).streamReader(None)
