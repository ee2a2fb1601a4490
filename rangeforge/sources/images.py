"""Camera frames as sparse pixels: image folders, calibration sets, and folders watched as a stream."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .scratch import mounted

#: What the image source gives: rows from the top, pixels from the left, channels blue, green, red.
PIXEL = "path string, x int, y int, gray short"


def pixels_of(images: DataFrame, least: int = 1) -> DataFrame:
    """(path, x, y, gray) of images read by Spark's image source; pixels under `least` are left out. Colour is weighed as in television."""
    i = F.col("image")
    n = i["nChannels"]
    at = lambda p, c: F.expr(f"cast(conv(hex(substring(image.data, {p} * image.nChannels + {c}, 1)), 16, 10) AS int)")
    each = images.select(F.col("image.origin").alias("path"), "image", F.explode(F.sequence(F.lit(0), i["width"] * i["height"] - 1)).alias("p"))
    gray = F.when(n == 1, at("p", 1)).otherwise(F.rint(0.114 * at("p", 1) + 0.587 * at("p", 2) + 0.299 * at("p", 3)).cast("int"))
    out = each.withColumn("gray", gray.cast("short")).where(F.col("gray") >= least)
    return out.select("path", (F.col("p") % F.col("image.width")).cast("int").alias("x"), F.floor(F.col("p") / F.col("image.width")).cast("int").alias("y"), "gray")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Sparse pixels of all images under a path; files that are no image are passed over."""
    return pixels_of(spark.read.format("image").option("dropInvalid", True).load(path))


def calibration_set(spark: SparkSession, images: str, distances: str) -> DataFrame:
    """(i, path, distance_m): images in name order with the numbers of a CSV's second column in file order; the counts must be equal."""
    table = spark.read.csv(distances, header=True)
    value = F.expr(f"try_cast(`{table.columns[1]}` AS double)")
    numbers = table.select(F.monotonically_increasing_id().alias("_o"), value.alias("distance_m")).where("distance_m IS NOT NULL")
    names = spark.read.format("binaryFile").load(images).select("path")
    rank = lambda c: F.row_number().over(Window.orderBy(c)) - 1  # noqa: E731  a set has some dozens of images
    left, right = names.withColumn("i", rank("path")), numbers.withColumn("i", rank("_o")).drop("_o")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} images, but {m} distances")
    return left.join(right, "i").select("i", "path", "distance_m")


def watch_frames(spark: SparkSession, path: str, *, files: int = 10) -> DataFrame:
    """A stream of the sparse pixels of images as they come to a folder."""
    like = spark.read.format("image").load(path).schema
    return pixels_of(spark.readStream.format("image").schema(like).option("dropInvalid", True).option("maxFilesPerTrigger", files).load(path))


def frame_rate(frames: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, frames, rate): frames a second from the first to the last, the rate that a camera really gave."""
    out = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    seconds = (F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1e6
    return out.select(*keys, "frames", F.when(seconds > 0, (F.col("frames") - 1) / seconds).alias("rate"))


def png_bytes(gray: np.ndarray) -> bytes:
    """A grey image of 8 bits."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = gray.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_images(pixels: DataFrame, folder: str, width: int, height: int) -> DataFrame:
    """Writes folder/<name>.png for each name of pixels (name, x, y, gray), dark elsewhere; gives (name, path) when it runs."""
    ship_package(pixels.sparkSession)
    root = mounted(folder)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf["name"].iloc[0])
        gray = np.zeros((height, width), np.uint8)
        np.maximum.at(gray, (pdf["y"].to_numpy(), pdf["x"].to_numpy()), pdf["gray"].to_numpy().astype(np.uint8))
        path = os.path.join(root, f"{name}.png")
        with open(f"{path}.{os.getpid()}.part", "wb") as f:
            f.write(png_bytes(gray))
        os.replace(f.name, path)
        return pd.DataFrame({"name": [name], "path": [path]})

    return pixels.groupBy("name").applyInPandas(write, "name string, path string")
