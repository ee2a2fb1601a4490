"""Queries that write the driver's tables in the formats of recordings and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fits
from ..operators import windows as w
from ..sources import calibration, images, las, pointcloud2, rosbag, tables
from ..sources.driver import MEASURED, POINTS, SIGNAL, measured_nodes, points, signal
from ..sources.scratch import mounted, scratch_folder
from . import detection_queries  # noqa: F401  registers vanishing_center
from .grid_queries import CELLS, states
from .registry import ORACLE_SQL, query

BAGS = [f"run{b}" for b in range(4)]
#: Frames of a recording in the order in which they are written; their times run backwards.
FRAMES = f"""{POINTS}, g AS (SELECT 'run' || bag AS bag, frame_idx, (1000 - frame_idx) * 100000000 AS ts_ns, count(*) AS n, sum(f)::BIGINT AS f, sum(lat)::BIGINT AS lat, sum(ver)::BIGINT AS ver, sum(intensity::FLOAT::DOUBLE) AS i FROM points GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY frame_idx) - 1 AS k FROM g)"""


def _cloud(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select(F.concat(F.lit("run"), "bag").alias("bag"), "frame_idx", ((1000 - F.col("frame_idx")) * 10**8).alias("ts_ns"), F.monotonically_increasing_id().alias("pt_idx"), F.col("f").alias("x"), F.col("lat").alias("y"), F.col("ver").alias("z"), "intensity", (F.col("frame_idx") % 32).alias("ring"))


def _messages(spark, sf_dir, frame_id: str = "twelve_chars") -> DataFrame:
    frames = pointcloud2.encode_frames(_cloud(spark, sf_dir), frame_id=frame_id)
    return frames.withColumn("topic", F.when(F.col("frame_idx") % 3 == 0, "/imu").otherwise("/points"))


def _bags(spark, sf_dir, order: str = "id") -> DataFrame:
    folder = scratch_folder(spark, "bags")
    rosbag.write_bags(_messages(spark, sf_dir), folder)
    rosbag.register(spark)
    return spark.read.format("rosbag").options(orderBy=order, rowsPerPartition="7").load(mounted(folder))


@query(f"WITH {FRAMES} SELECT bag, CASE WHEN frame_idx % 3 = 0 THEN '/imu' ELSE '/points' END AS topic, k AS frame_idx, ts_ns FROM fr")
def bag_messages(spark, sf_dir):
    """Messages of all recordings in a folder, in the order of their ids."""
    return _bags(spark, sf_dir).drop("data")


@query(f"WITH {FRAMES} SELECT bag, CASE WHEN frame_idx % 3 = 0 THEN '/imu' ELSE '/points' END AS topic, row_number() OVER (PARTITION BY bag ORDER BY ts_ns) - 1 AS frame_idx, ts_ns FROM fr")
def bag_messages_by_time(spark, sf_dir):
    return _bags(spark, sf_dir, "timestamp").drop("data")


@query(f"WITH {FRAMES} SELECT bag, k AS frame_idx, ts_ns FROM fr WHERE bag IN ('run1', 'run3') AND frame_idx % 3 <> 0 AND ts_ns > 98000000000")
def bag_messages_pushed(spark, sf_dir):
    """Recordings chosen by parts of their paths, with topic and time tested inside the source."""
    folder = scratch_folder(spark, "bags")
    rosbag.write_bags(_messages(spark, sf_dir), folder)
    rosbag.register(spark)
    return spark.read.format("rosbag").options(bags="run1,run3").load(mounted(folder)).where("topic = '/points' AND ts_ns > 98000000000").select("bag", "frame_idx", "ts_ns")


def _sums(decoded: DataFrame) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("double")).cast("long").alias(c)
    return decoded.groupBy("bag", "frame_idx", "ts_ns").agg(F.count("*").alias("n"), total("x"), total("y"), total("z"), F.round(F.sum(F.col("intensity").cast("double")), 2).alias("intensity"))


DECODED = f"WITH {FRAMES} SELECT bag, frame_idx, ts_ns, n, f AS x, lat AS y, ver AS z, round(i, 2) AS intensity FROM fr"


@query(DECODED)
def decoded_points(spark, sf_dir):
    """Points of messages, found by their headers."""
    return _sums(pointcloud2.decode_frames(_messages(spark, sf_dir)))


@query(DECODED)
def decoded_fixed(spark, sf_dir):
    """Points from a fixed byte on: the same where the header has the length that this takes for granted."""
    return _sums(pointcloud2.decode_frames(_messages(spark, sf_dir), layout="fixed200"))


@query(f"WITH {FRAMES} SELECT bag, frame_idx, ts_ns, n, f + CASE WHEN frame_idx % 2 = 1 THEN 1000 * n ELSE 0 END AS x, lat AS y, ver AS z, round(i, 2) AS intensity FROM fr")
def decoded_standard(spark, sf_dir):
    """Every second frame lies out of reach, so it is decoded from the fixed place, which its header fits."""
    far = F.when(F.col("frame_idx") % 2 == 1, F.col("x") + 1000).otherwise(F.col("x"))
    return _sums(pointcloud2.decode_standard(pointcloud2.encode_frames(_cloud(spark, sf_dir).withColumn("x", far), frame_id="twelve_chars")))


@query(f"WITH {FRAMES} SELECT bag, sum(n)::BIGINT AS points, count(*) AS frames FROM fr GROUP BY bag")
def archived_bags(spark, sf_dir):
    """Recordings packed in archives, each unpacked and read; a task for each archive."""
    bags = rosbag.write_bags(_messages(spark, sf_dir), scratch_folder(spark, "bags"))
    archives = tables.pack_archives(spark, bags, scratch_folder(spark, "archives"))
    unpacked = scratch_folder(spark, "unpacked")
    tables.unpack_archives(spark, archives, unpacked)
    frames = spark.read.format("rosbag").load(mounted(unpacked))
    return pointcloud2.decode_frames(frames).groupBy("bag").agg(F.count("*").alias("points"), F.count_distinct("frame_idx").alias("frames"))


@query(f"WITH {FRAMES} SELECT bag || '_' || frame_idx AS bag, n, f AS x, lat AS y, ver AS z, least(31, 0) AS classification FROM fr")
def las_points(spark, sf_dir):
    """One LAS file for each frame, written and read."""
    folder = scratch_folder(spark, "las")
    las.write_las(_cloud(spark, sf_dir), folder)
    total = lambda c: F.round(F.sum(c)).cast("long").alias(c)
    return las.read_las(spark, folder).groupBy("bag").agg(F.count("*").alias("n"), total("x"), total("y"), total("z"), F.max("classification").alias("classification"))


@query(f"WITH {FRAMES} SELECT bag || '_' || min(frame_idx) AS bag, sum(n)::BIGINT AS n, sum(f)::BIGINT AS x FROM fr GROUP BY fr.bag")
def las_ranges(spark, sf_dir):
    """One LAS file for each recording, read by many tasks in ranges of 64 kB, and only the columns asked for."""
    folder = scratch_folder(spark, "las")
    first = points(spark, sf_dir).groupBy(F.concat(F.lit("run"), "bag").alias("bag")).agg(F.min("frame_idx").alias("frame_idx"))
    las.write_las(_cloud(spark, sf_dir).drop("frame_idx").join(F.broadcast(first), "bag"), folder)
    found = spark.read.format("las").schema("bag string, x double").option("bytesPerPartition", "65536").load(folder)
    return found.groupBy("bag").agg(F.count("*").alias("n"), F.round(F.sum("x")).cast("long").alias("x"))


@query(f"WITH {FRAMES} SELECT bag || '_' || frame_idx AS bag, least(n, 20) AS n FROM fr")
def las_capped(spark, sf_dir):
    """At most 20 points of a file, chosen by a seed. The cap is the operator."""
    folder = scratch_folder(spark, "las")
    las.write_las(_cloud(spark, sf_dir), folder)
    return las.read_las(spark, folder, cap=20, seed=3).groupBy("bag").agg(F.count("*").alias("n"))


@query(f"WITH {SIGNAL} SELECT 'run' || bag AS scenario, event_id, printf('%.2f', round(d, 2)) AS d, fam FROM signal")
def runs_csv(spark, sf_dir):
    """One CSV folder for each recording, with fixed decimals; the recording is told by the folder's name."""
    folder = scratch_folder(spark, "runs")
    rows = signal(spark, sf_dir).select("bag", "event_id", F.round("d", 2).alias("d"), "fam")
    for b in range(8):
        tables.write_csv(rows.where(F.col("bag") == b).drop("bag"), f"{folder}/run{b}", {"d": 2})
    return tables.read_runs(spark, folder, "event_id long, d string, fam string").select("scenario", "event_id", "d", "fam")


@query(f"WITH {SIGNAL} SELECT bag, count(*) AS events, round(min(d), 4) AS least, round(max(d), 4) AS most, count(DISTINCT fam) AS families FROM signal GROUP BY bag")
def summary_json(spark, sf_dir):
    path = scratch_folder(spark, "summary")
    tables.write_json(signal(spark, sf_dir).groupBy("bag").agg(F.count("*").alias("events"), F.round(F.min("d"), 4).alias("least"), F.round(F.max("d"), 4).alias("most"), F.count_distinct("fam").alias("families")), path)
    return spark.read.json(path, schema="bag long, events long, least double, most double, families long")


@query(f"WITH {MEASURED} SELECT fan, vertical, 1 AS direction, i, round(d, 9) AS d, round(x0, 9) AS x0, round(m, 9) AS m FROM nodes")
def calibration_json(spark, sf_dir):
    path = scratch_folder(spark, "calibration")
    calibration.write_nodes(measured_nodes(spark, sf_dir), path)
    r = lambda c: F.round(c, 9).alias(c)
    return calibration.read_nodes(spark, path).select("fan", "vertical", "direction", "i", r("d"), r("x0"), r("m"))


@query("SELECT * FROM (SELECT 'no file' AS asked, 'computed' AS source, cx, cy FROM (" + ORACLE_SQL["vanishing_center"] + ") UNION ALL VALUES ('file', 'file', 600.5, 210.25))")
def centre_from_file(spark, sf_dir):
    """The centre of an image: a file's wins over the computed one."""
    computed = fits.vanishing_centre(measured_nodes(spark, sf_dir)).select(F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))
    path = scratch_folder(spark, "centre")
    calibration.write_centre(spark.range(1).select(F.lit(600.5).alias("cx"), F.lit(210.25).alias("cy")), path)
    asked = [calibration.centre_of(computed, p).withColumn("asked", F.lit(name)) for name, p in (("file", path), ("no file", f"{path}-none"))]
    return asked[0].unionByName(asked[1]).select("asked", "source", "cx", "cy")


@query(f"WITH {CELLS} SELECT DISTINCT bag, iu, iv FROM states WHERE st = 1")
def mask_store(spark, sf_dir):
    """A mask built where none is stored, and read where one is."""
    path = scratch_folder(spark, "mask")
    if tables.load_mask(spark, path) is None:
        tables.save_mask(w.dilated(states(spark, sf_dir).where("st = 1"), ["bag"], 0), path)
    return tables.load_mask(spark, path)


PIXELS = f"WITH {SIGNAL}, px AS (SELECT 'run' || bag AS name, (frame_idx % 64)::INT AS x, (frame_idx // 64 % 32)::INT AS y, max(1 + theta % 255)::INT AS gray FROM signal GROUP BY ALL)"


def _images(spark, sf_dir) -> str:
    folder = scratch_folder(spark, "images")
    s = signal(spark, sf_dir)
    pixels = s.select(F.concat(F.lit("run"), "bag").alias("name"), (F.col("frame_idx") % 64).alias("x"), (F.floor(F.col("frame_idx") / 64) % 32).alias("y"), (1 + F.col("theta") % 255).alias("gray"))
    images.write_images(pixels, folder, 64, 32).collect()
    return folder


def _named(pixels: DataFrame) -> DataFrame:
    return pixels.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "x", "y", F.col("gray").cast("int").alias("gray"))


@query(PIXELS + " SELECT * FROM px")
def image_pixels(spark, sf_dir):
    """Lit pixels of grey images."""
    return _named(images.read_frames(spark, _images(spark, sf_dir)))


@query(PIXELS + " SELECT name, row_number() OVER (ORDER BY name) - 1 AS i, 2.0 + 0.4 * (row_number() OVER (ORDER BY name) - 1) AS distance_m FROM (SELECT DISTINCT name FROM px)")
def calibration_images(spark, sf_dir):
    """Images in the order of their names with the distances of a table's second column, a heading and a remark left out."""
    folder, table = _images(spark, sf_dir), mounted(scratch_folder(spark, "distances"))
    n = spark.read.format("binaryFile").load(folder).count()
    with open(f"{table}/d.csv", "w") as f:
        f.write("name,distance\n,remark\n" + "".join(f"a,{2.0 + 0.4 * k:.1f}\n" for k in range(n)))
    found = images.calibration_set(spark, folder, f"{table}/d.csv")
    return found.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), F.col("i").cast("long").alias("i"), "distance_m")


@query(PIXELS + " SELECT * FROM px")
def image_stream(spark, sf_dir):
    """Lit pixels of images as a stream reads them from a folder."""
    folder, name = _images(spark, sf_dir), f"image_stream_{scratch_folder(spark, 'x')[-32:]}"
    stream = _named(images.watch_frames(spark, folder, files=3))
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(f"WITH {SIGNAL} SELECT bag, count(*) AS frames, round((count(*) - 1) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS rate FROM signal GROUP BY bag")
def camera_rate(spark, sf_dir):
    return images.frame_rate(signal(spark, sf_dir), ["bag"], "ts").withColumn("rate", F.round("rate", 9))
