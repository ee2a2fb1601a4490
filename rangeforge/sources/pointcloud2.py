"""Point clouds as they are recorded: CDR messages with a field list, decoded into typed points in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import finite, frames_mostly
from ..shipping import bound_batches
from .committed import pieces

#: Fixed values of the message format: field types by code.
KINDS = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
POINTS = "bag string, frame_idx long, ts_ns long, pt_idx int, x float, y float, z float, intensity float, ring int"
#: Points of a message that are given at a time.
CHUNK = 1 << 16
#: Points that are made into bytes at a time.
PACKED = 1 << 18
#: x, y, z, intensity as 4-byte floats, a ring byte and a time stamp: 26 bytes a point.
FIELDS_26 = (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("intensity", 12, 7), ("ring", 16, 2))


class _Cursor:
    """Reads a CDR body; numbers are aligned to their size behind the four-byte header."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4

    def number(self, size: int) -> int:
        self.at = 4 + -(-(self.at - 4) // size) * size
        value = int.from_bytes(self.data[self.at : self.at + size], "little")
        if self.at + size > len(self.data):
            raise ValueError("the message ends early")
        self.at += size
        return value

    def text(self) -> str:
        n = self.number(4)
        raw = self.data[self.at : self.at + n]
        self.at += n
        return raw.split(b"\0")[0].decode("utf-8", "replace")


@dataclass(frozen=True)
class Layout:
    step: int
    start: int
    count: int
    fields: dict[str, tuple[int, str]]


def read_layout(message: bytes) -> Layout:
    """Where the points of a message lie, from its header. The byte-order flag is read and not used."""
    c = _Cursor(message)
    c.number(4), c.number(4), c.text()
    height, width = c.number(4), c.number(4)
    fields = {}
    for _ in range(c.number(4)):
        name, offset, kind, _ = c.text(), c.number(4), c.number(1), c.number(4)
        if kind not in KINDS:
            raise ValueError(f"field {name} has type {kind}, which is none of {sorted(KINDS)}")
        fields[name] = (offset, KINDS[kind])
    c.number(1)
    step, _, size = c.number(4), c.number(4), c.number(4)
    if missing := {"x", "y", "z"} - fields.keys():
        raise ValueError(f"the message has no field {', '.join(sorted(missing))}")
    held = min(size, len(message) - c.at)
    return Layout(step, c.at, min(height * width, held // step) if step else 0, fields)


def fixed_layout(message: bytes, start: int = 200) -> Layout:
    """26-byte points from a fixed byte on. The third value is an attribute, not a height, if the header is of another length."""
    return Layout(26, start, max(0, (len(message) - start) // 26), {n: (o, KINDS[k]) for n, o, k in FIELDS_26})


def columns_of(message: bytes, layout: Layout, wanted: tuple[str, ...]) -> dict[str, np.ndarray | None]:
    """Wanted fields as arrays; None for a field that the message has not."""
    raw = np.frombuffer(message, np.uint8, layout.count * layout.step, layout.start).reshape(layout.count, layout.step)
    out: dict[str, np.ndarray | None] = {}
    for name in wanted:
        if name not in layout.fields:
            out[name] = None
            continue
        offset, kind = layout.fields[name]
        out[name] = np.ascontiguousarray(raw[:, offset : offset + np.dtype(kind).itemsize]).view(kind).ravel()
    return out


def _head(n: int, frame_id: str, stamp_ns: int, fields, step: int) -> bytes:
    out = bytearray(b"\0\1\0\0")

    def number(value: int, size: int) -> None:
        out.extend(b"\0" * (-(len(out) - 4) % size))
        out.extend(int(value).to_bytes(size, "little"))

    def text(value: str) -> None:
        raw = value.encode() + b"\0"
        number(len(raw), 4)
        out.extend(raw)

    number(stamp_ns // 10**9, 4), number(stamp_ns % 10**9, 4), text(frame_id)
    number(1, 4), number(n, 4), number(len(fields), 4)
    for name, offset, kind in fields:
        text(name), number(offset, 4), number(kind, 1), number(1, 4)
    number(0, 1), number(step, 4), number(step * n, 4), number(step * n, 4)
    return bytes(out)


def _body(points: dict[str, np.ndarray], fields, step: int) -> bytes:
    n = len(points["x"])
    body = np.zeros((n, step), np.uint8)
    for name, offset, kind in fields:
        if name in points:
            v = np.asarray(points[name]).astype(KINDS[kind])
            body[:, offset : offset + v.itemsize] = v.view(np.uint8).reshape(n, -1)
    return body.tobytes()


def encode_cloud(points: dict[str, np.ndarray], frame_id: str = "sensor", stamp_ns: int = 0, fields=FIELDS_26, step: int = 26) -> bytes:
    """A message of the given points, for fixtures and round trips."""
    return _head(len(points["x"]), frame_id, stamp_ns, fields, step) + _body(points, fields, step)


def decode_frames(frames: DataFrame, *, layout: str = "header") -> DataFrame:
    """points (bag, frame_idx, ts_ns, pt_idx, x, y, z, intensity, ring) of frames (bag, frame_idx, ts_ns, data).

    layout is "header" or "fixed200". A null message has no points; missing
    intensity or ring is null. Place filters and column choices after this; the
    decode itself reads the listed fields only. A task holds one message and gives CHUNK points at a time.
    """
    if layout not in ("header", "fixed200"):
        raise ValueError('layout must be "header" or "fixed200"')
    bound_batches(frames.sparkSession)
    find = read_layout if layout == "header" else fixed_layout
    names = ["bag", "frame_idx", "ts_ns", "pt_idx", "x", "y", "z", "intensity", "ring"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.float32(), pa.float32(), pa.float32(), pa.int32()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bag, frame, ts, data = (c[row].as_py() for c in batch.columns)
                if data is None:
                    continue
                where = find(data)
                got = columns_of(data, where, ("x", "y", "z", "intensity", "ring"))
                for at in range(0, where.count, CHUNK):
                    n = min(CHUNK, where.count - at)
                    columns = [pa.repeat(pa.scalar(v, t), n) for v, t in zip((bag, frame, ts), types[:3], strict=True)] + [pa.array(np.arange(at, at + n, dtype=np.int32))]
                    columns += [pa.nulls(n, t) if got[c] is None else pa.array(got[c][at : at + n]).cast(t) for c, t in zip(names[4:], types[4:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return frames.select("bag", "frame_idx", "ts_ns", "data").mapInArrow(decode, POINTS)


def _plausible(x_max: float, y_max: float, z_max: float) -> Column:
    return finite("x") & finite("y") & finite("z") & (F.abs("x") < x_max) & (F.abs("y") < y_max) & (F.abs("z") < z_max)


def decode_standard(frames: DataFrame, *, x_max: float = 300.0, y_max: float = 300.0, z_max: float = 100.0, share: float = 0.9) -> DataFrame:
    """decode_frames by the header, but frames under `share` of whose points are finite and within these limits are decoded from the fixed place instead."""
    keys = ["bag", "frame_idx"]
    points = decode_frames(frames)
    good = frames_mostly(points, keys, _plausible(x_max, y_max, z_max), share)
    rest = frames.join(good.select(*keys).distinct(), keys, "left_anti")
    return good.unionByName(decode_frames(rest, layout="fixed200"))


def _blobs(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows' bytes between each two bounds, as binary values without a copy for each."""
    size = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(rows)])


def encode_frames(points: DataFrame, *, frame_id: str = "sensor") -> DataFrame:
    """(bag, frame_idx, ts_ns, data): one message for each frame of points (bag, frame_idx, ts_ns, pt_idx, x, y, z, intensity, ring).

    Points are made into bytes where they are read, PACKED at a time, and only
    these pieces of frames are shuffled. A task holds the bytes of one message.
    """
    bound_batches(points.sparkSession)
    fields, names = (*FIELDS_26, ("timestamp", 18, 8)), ["bag", "frame_idx", "ts_ns", "data"]
    packed = "bag string, frame_idx long, ts_ns long, first long, ids binary, body binary"

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """A row for each frame of these points: its time, its points' first number, their numbers and bytes, in order."""
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        own = {c: rows.column(k) for k, c in enumerate(rows.schema.names)}
        ids = own["pt_idx"].fill_null(-(1 << 63)).to_numpy()
        bags, frames = (pc.fill_null(own[c].dictionary_encode().indices, -1).to_numpy().astype(np.int64) for c in ("bag", "frame_idx"))
        keys = bags * (rows.num_rows + 1) + frames
        order = np.lexsort((ids, keys))
        starts = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
        bounds, heads, ids = np.r_[starts, len(order)], pa.array(order[starts]), ids[order]
        body = _body({c: own[c].to_numpy(zero_copy_only=False)[order] for c in ("x", "y", "z", "intensity", "ring")}, fields, 26)
        columns = [*(own[c].take(heads) for c in names[:3]), pa.array(ids[starts]), _blobs(ids, bounds), _blobs(np.frombuffer(body, np.uint8).reshape(-1, 26), bounds)]
        return pa.RecordBatch.from_arrays(columns, names=[*names[:3], "first", "ids", "body"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= PACKED:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def message(bag, frame, ts: int, ids: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
        if (ids[1:] < ids[:-1]).any():  # pieces whose numbers overlap
            body = body[np.argsort(ids, kind="stable")]
        data = b"".join([_head(len(body), frame_id, ts, fields, 26), body])
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((bag, frame, ts, data), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bag, frame), group in groupby(pieces(batches, ("bag", "frame_idx")), itemgetter(0)):
            ts, ids, bodies = None, [], []
            for _, piece in group:
                own = {c: piece.column(piece.schema.get_field_index(c)) for c in ("ts_ns", "ids", "body")}
                ts = own["ts_ns"][0].as_py() if ts is None else ts
                ids += [np.frombuffer(v.as_py(), np.int64) for v in own["ids"]]
                bodies += [np.frombuffer(v.as_py(), np.uint8).reshape(-1, 26) for v in own["body"]]
            yield message(bag, frame, ts, np.concatenate(ids), np.concatenate(bodies))

    rows = points.select("bag", "frame_idx", "ts_ns", F.col("pt_idx").cast("long"), "x", "y", "z", "intensity", "ring").mapInArrow(packs, packed)
    rows = rows.repartition("bag", "frame_idx").sortWithinPartitions("bag", "frame_idx", "first")
    return rows.drop("first").mapInArrow(encode, "bag string, frame_idx long, ts_ns long, data binary")


def stamp_of(message: bytes) -> int:
    s, ns = struct.unpack_from("<iI", message, 4)
    return s * 10**9 + ns
