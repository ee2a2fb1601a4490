"""LAS 1.2 point files, uncompressed, as a Spark data source: spark.read.format("las").load(path), df.write.format("las").save(path)."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.selection import finite, seeded_cap
from ..shipping import ship_package
from .committed import CommittedWriter, pieces
from .scratch import plain

SCHEMA = "bag string, pt_idx int, x double, y double, z double, intensity int, classification int, source_id int"
#: Fixed values of the format: header size, and the place and kind of the values in a point record of formats 0 to 3.
HEADER, LENGTHS = 227, {0: 20, 1: 28, 2: 26, 3: 34}
SCALE = 0.001


#: Records that a task reads at a time.
CHUNK = 1 << 16
#: Place of the classification in a record of format 0.
CLASS_BYTE = 15


@dataclass(frozen=True)
class Header:
    """Where the records of a file begin, their length and number, and what turns them into metres."""

    start: int
    length: int
    count: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]


def read_header(data: bytes) -> Header:
    if data[:4] != b"LASF" or len(data) < HEADER:
        raise ValueError("no LAS file")
    start, kind, length, count = struct.unpack_from("<I", data, 96)[0], data[104], *struct.unpack_from("<HI", data, 105)
    if kind & 0x80 or kind not in LENGTHS:
        raise ValueError(f"point format {kind} is compressed or not known")
    if length < LENGTHS[kind]:
        raise ValueError(f"records of {length} bytes are too short for point format {kind}")
    numbers = struct.unpack_from("<6d", data, 131)
    return Header(start, length, count, numbers[:3], numbers[3:])


def read_records(data: bytes, head: Header, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The columns asked for of whole records; only their bytes are taken."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, head.length)
    take = lambda lo, t: np.ascontiguousarray(raw[:, lo : lo + np.dtype(t).itemsize]).view(t).ravel()
    places = {"intensity": (12, "<u2"), "classification": (15, "u1"), "source_id": (18, "<u2")}
    out = {}
    for c in columns:
        if c in places:
            out[c] = take(*places[c]).astype(np.int32)
        elif c in ("x", "y", "z"):
            k = "xyz".index(c)
            out[c] = take(4 * k, "<i4") * head.scale[k] + head.offset[k]
    return out


def read_bytes(data: bytes) -> dict[str, np.ndarray]:
    head = read_header(data)
    if len(data) < head.start + head.count * head.length:
        raise ValueError("the LAS file ends early")
    return read_records(data[head.start : head.start + head.count * head.length], head, ("x", "y", "z", "intensity", "classification", "source_id"))


def _records(xyz: np.ndarray, intensity, ring: np.ndarray, frame) -> np.ndarray:
    body = np.zeros(len(xyz), np.dtype([("xyz", "<i4", 3), ("i", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("src", "<u2")]))
    body["xyz"], body["flags"] = xyz, 9
    body["i"] = np.clip(np.nan_to_num(np.asarray(intensity, float)), 0, 65535)
    body["cls"] = np.clip(ring, 0, 31)
    body["src"] = np.asarray(frame) % 65536
    return body


def _head(n: int, low: np.ndarray, high: np.ndarray) -> bytes:
    head = bytearray(HEADER)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HI", head, 94, HEADER, HEADER)
    struct.pack_into("<BHI", head, 104, 0, LENGTHS[0], n)
    struct.pack_into("<6d", head, 131, SCALE, SCALE, SCALE, 0, 0, 0)
    struct.pack_into("<6d", head, 179, *[v * SCALE for pair in zip(high, low, strict=True) for v in pair])
    return bytes(head)


def write_bytes(x, y, z, intensity, ring, frame) -> bytes:
    """Format 0 at a millimetre: intensity within 16 bits, missing as 0; classification is the ring above the least; the source is the frame."""
    xyz = np.round(np.stack([x, y, z], axis=1) / SCALE).astype("<i4")
    ring = np.nan_to_num(np.asarray(ring, float))
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    return _head(len(xyz), low, high) + _records(xyz, intensity, ring - (ring.min() if len(ring) else 0), frame).tobytes()


def write_pieces(path: str, parts: Iterator[pa.RecordBatch]) -> None:
    """The file of write_bytes, written piece by piece. The rings lie beside it until the least one is known."""
    n, least, low, high = 0, np.inf, np.full(3, np.inf), np.full(3, -np.inf)
    with open(path, "w+b") as f, tempfile.TemporaryFile(dir=os.path.dirname(path)) as rings:
        f.write(bytes(HEADER))
        for part in parts:
            own = {c: part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "z", "intensity", "ring", "frame_idx")}
            place = np.stack([own[c] for c in "xyz"], axis=1)
            kept = np.isfinite(place).all(axis=1)
            if not kept.any():
                continue
            xyz, ring = np.round(place[kept] / SCALE).astype("<i4"), np.nan_to_num(own["ring"][kept])
            f.write(_records(xyz, own["intensity"][kept], np.zeros(len(xyz)), own["frame_idx"][kept].astype(np.int64)).tobytes())
            rings.write(ring.tobytes())
            n, least, low, high = n + len(xyz), min(least, ring.min()), np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0))
        rings.seek(0)
        for at in range(0, n, CHUNK):
            many, place = min(CHUNK, n - at), HEADER + at * LENGTHS[0]
            f.seek(place)
            body = np.frombuffer(bytearray(f.read(many * LENGTHS[0])), np.uint8).reshape(many, LENGTHS[0])
            body[:, CLASS_BYTE] = np.clip(np.frombuffer(rings.read(8 * many), float) - least, 0, 31)
            f.seek(place)
            f.write(body.tobytes())
        f.seek(0)
        f.write(_head(n, *((low, high) if n else (np.zeros(3), np.zeros(3)))))


def bag_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class LasSpans(InputPartition):
    """(path, first byte, byte behind the last one, size) of ranges; a record is read where it begins."""

    spans: tuple[tuple[str, int, int, int], ...]


@dataclass
class LasReader(DataSourceReader):
    """Ranges are planned by the sizes of files alone; each task reads the headers of its own files, so the driver opens none."""

    path: str
    columns: tuple[str, ...]
    per_partition: int
    tests: list[set] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        """Files that a test on bag rules out are not read; all other tests are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("bag",):
                self.tests.append({f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def partitions(self) -> list[LasSpans]:
        if os.path.isfile(self.path):
            found = [(self.path, os.path.getsize(self.path))]
        else:
            with os.scandir(self.path) as entries:
                found = sorted((e.path, e.stat().st_size) for e in entries if e.name.endswith(".las") and not e.name.startswith(("_", ".")))
        out, held, room = [], [], self.per_partition
        for path, size in found:
            if not all(bag_name(path) in names for names in self.tests):
                continue
            at = 0
            while at < size or at == 0:
                end = min(max(size, 1), at + room)
                held.append((path, at, end, size))
                room, at = room - (end - at), end
                if room <= 0:
                    out.append(LasSpans(tuple(held)))
                    held, room = [], self.per_partition
        return [*out, LasSpans(tuple(held))] if held or not out else out

    def read(self, part: LasSpans) -> Iterator[pa.RecordBatch]:
        for path, lo, hi, size in part.spans:
            with open(path, "rb") as f:
                head = read_header(f.read(HEADER))
                if size < head.start + head.count * head.length:
                    raise ValueError(f"{path} ends early")
                first, last = (min(head.count, max(0, -(-(b - head.start) // head.length))) for b in (lo, hi))
                f.seek(head.start + first * head.length)
                for at in range(first, last, CHUNK):
                    n = min(CHUNK, last - at)
                    got = read_records(f.read(n * head.length), head, self.columns)
                    got |= {"bag": pa.array([bag_name(path)] * n, pa.string()), "pt_idx": np.arange(at, at + n, dtype=np.int32)}
                    yield pa.RecordBatch.from_arrays([pa.array(got[c]) for c in self.columns], names=list(self.columns))


class LasWriter(CommittedWriter):
    """A file is written by one task, which holds a batch of its points at a time."""

    suffix = ".las"

    def files(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, str]]:
        for k, ((bag, frame), group) in enumerate(groupby(pieces(batches, ("bag", "frame_idx")), itemgetter(0))):
            if bag is None or frame is None:
                raise ValueError("points to be written need a bag and a frame_idx")
            part = os.path.join(folder, f"{k}.part")
            write_pieces(part, (piece for _, piece in group))
            yield part, f"{bag}_{frame}.las"


class LasSource(DataSource):
    """Options: path; bytesPerPartition. Give a schema of some columns of SCHEMA to decode no others.

    Written rows need bag, frame_idx, x, y, z, intensity and ring, those of a frame together: a frame is one file,
    <bag>_<frame_idx>.las. Points without a finite place are left out; a frame that has no other is a file without points.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        for f in schema.fields:
            if f"{f.name} {f.dataType.simpleString()}" not in SCHEMA.split(", "):
                raise ValueError(f"LAS files have no column {f.name} {f.dataType.simpleString()}; they have {SCHEMA}")
        return LasReader(plain(self.options["path"]), tuple(schema.names), int(self.options.get("bytesPerPartition", str(32 << 20))))

    def writer(self, schema, overwrite: bool) -> LasWriter:
        missing = {"bag", "frame_idx", "x", "y", "z", "intensity", "ring"} - set(schema.names)
        if missing:
            raise ValueError(f"LAS files need the columns {sorted(missing)}")
        return LasWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)


def read_las(spark: SparkSession, path: str, *, cap: int | None = None, seed: int = 0) -> DataFrame:
    """Finite points of all LAS files under a path; bag is the file's name. cap: so many points of a file at most, chosen by the seed.

    Files on a mounted path are read in ranges; elsewhere Spark's binary reader takes each whole.
    """
    if "://" in path.removeprefix("file://"):
        points = _whole_files(spark, path)
    else:
        register(spark)
        points = spark.read.format("las").load(path)
    points = points.where(finite("x") & finite("y") & finite("z"))
    return points if cap is None else seeded_cap(points, ["bag"], "pt_idx", cap, seed)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    ship_package(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = read_bytes(data)
                n = len(got["x"])
                yield pa.RecordBatch.from_arrays([pa.array([bag_name(name)] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, got.values())], names=["bag", "pt_idx", *got])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content").mapInArrow(decode, SCHEMA)


def write_las(points: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes folder/<bag>_<frame_idx>.las for each frame of points, in the order of pt_idx; all files or none."""
    register(points.sparkSession)
    rows = points.repartition("bag", "frame_idx").sortWithinPartitions("bag", "frame_idx", "pt_idx")
    rows.select("bag", "frame_idx", "x", "y", "z", "intensity", "ring").write.format("las").mode(mode).save(folder)
