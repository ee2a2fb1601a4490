"""Table sources and sinks: CSV of several runs, JSON summaries, masks, archives."""

from __future__ import annotations

import os
import tarfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .scratch import mounted


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files of several runs with `scenario`, the name of the folder each lies in."""
    rows = spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv")
    return rows.withColumn("scenario", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def write_csv(rows: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; columns named in `decimals` are written with that many digits."""
    for c, n in (decimals or {}).items():
        rows = rows.withColumn(c, F.format_string(f"%.{n}f", F.col(c).cast("double")))
    rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_mask(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


def load_mask(spark: SparkSession, path: str) -> DataFrame | None:
    """A mask written before; None if there is none, for the caller to build it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def unpack_archive(path: str, folder: str) -> str:
    """The first bag of a zstd-compressed tar archive (links are followed), streamed into a mounted folder."""
    import zstandard

    root = mounted(folder)
    with open(os.path.realpath(path), "rb") as raw, zstandard.ZstdDecompressor().stream_reader(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
        for member in tar:
            if member.isfile() and member.name.endswith(".db3"):
                if not member.size:
                    raise ValueError(f"{path}: {member.name} is empty")
                out = os.path.join(root, os.path.basename(member.name))
                with open(f"{out}.part", "wb") as f:
                    held = tar.extractfile(member)
                    while piece := held.read(1 << 20):
                        f.write(piece)
                os.replace(f"{out}.part", out)
                return out
    raise ValueError(f"{path} holds no bag")


def pack_archive(paths: list[str], out: str) -> str:
    """A zstd-compressed tar archive of files."""
    import zstandard

    with open(out, "wb") as raw, zstandard.ZstdCompressor().stream_writer(raw) as packed, tarfile.open(fileobj=packed, mode="w|") as tar:
        for path in paths:
            tar.add(path, os.path.basename(path))
    return out


def _each(spark: SparkSession, paths: list[str], work: Callable[[str], str]) -> list[str]:
    """Names that work gives for each path; a path is one task's."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([work(p) for p in batch.column(0).to_pylist()], pa.string())], names=["path"])

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return sorted(r.path for r in rows.mapInArrow(run, "path string").collect())


def pack_archives(spark: SparkSession, bags: list[str], folder: str) -> list[str]:
    """folder/<bag>.tar.zst for each bag, put in place whole; gives the archives' paths."""
    root = mounted(folder)

    def pack(path: str) -> str:
        out = os.path.join(root, os.path.splitext(os.path.basename(path))[0] + ".tar.zst")
        os.replace(pack_archive([path], f"{out}.{uuid.uuid4().hex}"), out)
        return out

    return _each(spark, bags, pack)


def unpack_archives(spark: SparkSession, archives: list[str], folder: str) -> list[str]:
    """folder/<archive>/ with the first bag of each archive; gives the bags' paths."""
    root = mounted(folder)
    return _each(spark, archives, lambda path: unpack_archive(path, os.path.join(root, os.path.basename(path).removesuffix(".tar.zst"))))


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a bag or points of a LAS file, by the name's ending."""
    from . import las, rosbag

    if path.endswith(".las"):
        return las.read_las(spark, path)
    if path.endswith(".db3"):
        rosbag.register(spark)
        return spark.read.format("rosbag").load(path)
    raise ValueError(f"{path}: expected .las or .db3")
