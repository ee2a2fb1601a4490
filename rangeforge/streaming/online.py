"""Structured Streaming versions of the frame-ordered operators. A frame comes as one row with its lit cells, so state holds cells, never points.

Every stream has the columns bag, ts_ns and frame_idx. Frames may come in any
order and over any batches: each is held back until the watermark on ts_ns has
passed it, and those of a recording are then taken in the order (ts_ns,
frame_idx). Frames later than the watermark are dropped and counted
(late_frames). A frame that comes twice counts once. What lies within `late` of
the newest frame of all recordings comes out once the watermark moves on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..config import Grid, ShadowConfig
from ..operators.folds import tracked
from ..operators.grids import LIT, extent
from ..shipping import ship_package
from ..sources.pointcloud2 import columns_of, read_layout

LATE = "5 seconds"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pack_frames(states: DataFrame, time: str = "ts_ns") -> DataFrame:
    """(bag, ts_ns, frame_idx, lit): sorted codes iu << 20 | iv of each frame's lit cells, from states of a batch that carry their frame's time."""
    code = F.shiftleft(F.col("iu").cast("long"), 20).bitwiseOR(F.col("iv").cast("long"))
    return states.groupBy("bag", F.col(time).alias("ts_ns"), "frame_idx").agg(F.sort_array(F.collect_list(F.when(F.col("st") == LIT, code))).alias("lit"))


def lit_frames(messages: DataFrame, d0: float, grid: Grid, f_min: float = 0.3) -> DataFrame:
    """(bag, ts_ns, frame_idx, lit) of point cloud messages (bag, ts_ns, frame_idx, data), decoded one by one as they come: x is ahead, y to the side, z up.

    A cell is lit if its nearest point lies beyond the plane at d0. Null messages
    and those without a point on the grid give no row.
    """
    ship_package(messages.sparkSession)

    def codes(data: bytes) -> np.ndarray | None:
        got = columns_of(data, read_layout(data), ("x", "y", "z"))
        f, side, up = (got[c].astype(float) for c in "xyz")
        ahead = f > f_min
        f, u, v = f[ahead], side[ahead] * d0 / f[ahead], up[ahead] * d0 / f[ahead]
        on = (u >= grid.u_lo) & (u < grid.u_hi) & (v >= grid.v_lo) & (v < grid.v_hi)
        place = [((w[on] - lo) / grid.res + 1e-6).astype(np.int64) for w, lo in ((u, grid.u_lo), (v, grid.v_lo))]
        cells, at = np.unique(place[0] << 20 | place[1], return_inverse=True)
        nearest = np.full(len(cells), np.inf)
        np.minimum.at(nearest, at, f[on])
        return cells[nearest > d0] if len(cells) else None

    def pack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            lit = [None if data is None else codes(bytes(data)) for data in pdf["data"]]
            yield pdf[["bag", "ts_ns", "frame_idx"]].assign(lit=lit)[[v is not None for v in lit]]

    return messages.select("bag", "ts_ns", "frame_idx", "data").mapInPandas(pack, "bag string, ts_ns long, frame_idx long, lit array<long>")


def _cells(codes: np.ndarray) -> dict:
    return {"iu": (codes >> 20).astype(np.int32), "iv": (codes & 0xFFFFF).astype(np.int32)}


#: Frames and bytes that are stepped through at once.
AT_ONCE, BYTES_AT_ONCE = 4000, 8 << 20

_ARROW = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


class Ordered(StatefulProcessor):
    """Holds frames back until the watermark has passed them and gives them to `step` in order. Subclasses keep what they remember in state of their own.

    Frames that come are sorted some at a time, and each such run is held in
    blocks of bounded size. Frames that are ready are merged from the runs, of
    which one block each is in memory, and only of those that have begun by then.
    """

    #: Columns of a frame beside bag, ts_ns and frame_idx, and those that come out beside bag.
    takes, gives = "", ""
    #: Bytes of frames that are sorted at once and of a block of them; runs that are merged at once.
    SORTED, BLOCK, MERGED = 32 << 20, 256 << 10, 64

    @classmethod
    def taken(cls) -> list[str]:
        return ["ts_ns", "frame_idx", *(c.split()[0] for c in cls.takes.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        # came: the number of the run that a frame came with.
        self.schema = pa.schema(list(zip(["came", *self.taken()], [pa.int64()] * 3 + [_ARROW[c.split()[1]] for c in self.takes.split(", ")], strict=True)))
        self.blocks = handle.getMapState("blocks", "run long, block long", "frames binary")
        self.runs = handle.getMapState("runs", "run long", "first long, block long, stop long")
        self.count = handle.getValueState("count", "runs long")
        self.open(handle)

    def open(self, handle) -> None:
        """Opens the state that `step` needs."""

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows without bag from frames (frame_idx, columns of `takes`) that follow one another."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: list[pa.RecordBatch] = []
        run = first = self.count.get()[0] if self.count.exists() else 0
        for pdf in rows:
            came.append(pa.RecordBatch.from_pandas(pdf[self.schema.names[1:]].assign(came=run), self.schema, preserve_index=False))
            if sum(b.nbytes for b in came) >= self.SORTED:
                self._put(run, 0, [_in_order(came)])
                came, run = [], run + 1
        if came:
            self._put(run, 0, [_in_order(came)])
            run += 1
        if run > first:
            self.count.update((run,))
        yield from self._release(key, timerValues)

    def _put(self, run: int, start: int, tables: Iterable[pa.Table]) -> None:
        """Writes frames in order as the run's blocks from `start` on, which are all that it has then."""
        first, stop = None, start
        for table in tables:
            many = max(1, self.BLOCK * table.num_rows // max(1, table.nbytes))
            for at in range(0, table.num_rows, many):
                part = table.slice(at, many).combine_chunks()
                first = part["ts_ns"][0].as_py() if first is None else first
                self._write(run, stop, part)
                stop += 1
        self.runs.updateValue((run,), (first, start, stop))

    def _write(self, run: int, block: int, table: pa.Table) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema) as f:
            f.write_table(table)
        self.blocks.updateValue((run, block), (out.getvalue().to_pybytes(),))

    def _take(self, run: int, block: int) -> pa.Table:
        with pa.ipc.open_stream(bytes(self.blocks.getValue((run, block))[0])) as f:
            table = f.read_all()
        self.blocks.removeKey((run, block))
        return table

    def _merged(self, runs: dict[int, tuple], limit: int | None) -> Iterator[pa.Table]:
        """Frames before `limit` of runs (first, block, stop), in order, some blocks at a time; runs are left with those from it on. Of a frame that came twice the last counts."""
        beyond = np.iinfo(np.int64).max if limit is None else limit
        waiting = sorted(((first, run) for run, (first, _, _) in runs.items() if limit is None or first < beyond), reverse=True)
        opened: dict[int, list] = {}  # run to its frames in memory, its next block and where its blocks stop
        while waiting or opened:
            # All frames before `bound` are in memory, once the runs that begin before it are open.
            bound = min([beyond, *(table["ts_ns"][-1].as_py() for table, block, stop in opened.values() if block < stop)])
            while waiting and waiting[-1][0] <= bound:
                run = waiting.pop()[1]
                _, block, stop = runs[run]
                table = self._take(run, block)
                opened[run] = [table, block + 1, stop]
                if block + 1 < stop:
                    bound = min(bound, table["ts_ns"][-1].as_py())
            parts = []
            for run, own in sorted(opened.items()):
                table, block, stop = own
                ready = int(np.searchsorted(table["ts_ns"].to_numpy(), bound)) if bound < beyond or limit is not None else table.num_rows
                parts += table.slice(0, ready).to_batches()
                table = table.slice(ready)
                if block < stop and (not table.num_rows or table["ts_ns"][-1].as_py() == bound < beyond):
                    table, block = pa.concat_tables([table, self._take(run, block)]), block + 1
                own[:] = table, block, stop
                if not table.num_rows:
                    del opened[run]
                    self.runs.removeKey((run,))
            if parts:
                yield _in_order(parts)
            if bound == beyond:
                break
        for run, (table, block, stop) in opened.items():
            self._write(run, block - 1, table.combine_chunks())
            self.runs.updateValue((run,), (table["ts_ns"][0].as_py(), block - 1, stop))

    def _held(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.runs.iterator()}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        limit = (timerValues.getCurrentWatermarkInMs() + 1) * 1_000_000
        ready = {run: own for run, own in self._held().items() if own[0] < limit}
        while len(ready) > self.MERGED:
            # The oldest ones become one, in place of the last of them.
            oldest = {run: ready.pop(run) for run in sorted(ready)[: self.MERGED]}
            last, (_, _, stop) = max(oldest.items())
            self._put(last, stop, self._merged(oldest, None))
            ready[last] = tuple(self.runs.getValue((last,)))
        for table in self._merged(ready, limit) if ready else ():
            many = min(AT_ONCE, max(1, BYTES_AT_ONCE * table.num_rows // max(1, table.nbytes)))
            for at in range(0, table.num_rows, many):
                part = table.slice(at, many).combine_chunks()
                for rows in self.step(list(zip(*map(_values, part.columns[2:]), strict=True))):
                    rows.insert(0, "bag", key[0])
                    yield rows
        rest = [first for first, _, _ in self._held().values()]
        if rest:
            self.handle.registerTimer(min(rest) // 1_000_000)

    def close(self) -> None:
        pass


def _in_order(batches: list[pa.RecordBatch]) -> pa.Table:
    """Frames by (ts_ns, frame_idx); of one that is there twice the last stays."""
    table = pa.Table.from_batches(batches).combine_chunks()
    came, ts, n = (table[c].to_numpy() for c in ("came", "ts_ns", "frame_idx"))
    order = np.lexsort((came, n, ts))
    ts, n = ts[order], n[order]
    return table.take(pa.array(order[np.append((ts[1:] != ts[:-1]) | (n[1:] != n[:-1]), True)]))


def _values(column: pa.ChunkedArray) -> list:
    """A column's values; arrays are numpy's."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    own = column.combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    values, ends, there = own.values.to_numpy(zero_copy_only=False), own.offsets.to_pylist(), own.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], there)]


def _ordered(rows: DataFrame, processor: Ordered, late: str) -> DataFrame:
    spark = rows.sparkSession
    ship_package(spark)
    if spark.conf.get(_STORE, "") != _ROCKS:
        spark.conf.set(_STORE, _ROCKS)  # the only store that keeps map and list state and timers
    timed = rows.select("bag", *processor.taken()).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", late)
    kind = rows.schema["bag"].dataType.simpleString()
    return timed.groupBy("bag").transformWithStateInPandas(processor, f"bag {kind}, {processor.gives}", "append", "eventTime")


def late_frames(query: StreamingQuery) -> int:
    """Frames that a query has dropped so far because they came after the watermark, by its kept progress reports."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) if isinstance(s, dict) else int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


class Consensus(Ordered):
    takes, gives = "lit array<long>", "frame_idx long, iu int, iv int, kind string"

    def __init__(self, window: int, frac: float):
        self.window, self.frac = window, frac

    def open(self, handle) -> None:
        self.ring = handle.getListState("ring", "lit array<long>")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        ring = [np.array(lit, np.int64) for (lit,) in self.ring.get()]
        for frame, lit in frames:
            lit = np.array(lit, np.int64)
            if len(ring) == self.window:
                yield compared(ring, lit, self.frac).assign(frame_idx=frame)[["frame_idx", "iu", "iv", "kind"]]
            ring = [*ring, lit][-self.window :]
        self.ring.put([(lit.tolist(),) for lit in ring])


def compared(ring: list[np.ndarray], lit: np.ndarray, frac: float) -> pd.DataFrame:
    """(iu, iv, kind): cells of the ring's consensus that are not lit (shadow), and lit ones outside it (object)."""
    codes, counts = np.unique(np.concatenate(ring), return_counts=True)
    reference = codes[counts / len(ring) > frac]
    parts = [pd.DataFrame(_cells(cells)).assign(kind=kind) for kind, cells in (("shadow", np.setdiff1d(reference, lit)), ("object", np.setdiff1d(lit, reference)))]
    return pd.concat(parts, ignore_index=True)


def consensus_stream(frames: DataFrame, *, window: int = 5, frac: float = 0.5, late: str = LATE) -> DataFrame:
    """(bag, frame_idx, iu, iv, kind) of frames (bag, ts_ns, frame_idx, lit) against the consensus of the `window` frames before: shadows and objects; nothing until the window is full."""
    return _ordered(frames, Consensus(window, frac), late)


def primed_geometry(points: np.ndarray, config: ShadowConfig) -> tuple[tuple[int, int, int, int], Grid]:
    """(forward, sign, lateral, vertical) and the grid of a sample of points (x, y, z), by the rules of detect_axes and extent."""
    low, mid, high = np.percentile(points, (1, 50, 99), axis=0)
    span, offset = high - low, np.abs((low + high) / 2)
    forward = int(np.argmax(span))
    a, b = (i for i in range(3) if i != forward)
    close = abs(span[a] - span[b]) <= 0.2 * max(span[a], span[b])
    lateral, vertical = (a, b) if (offset[a] < offset[b] if close else span[a] > span[b]) else (b, a)
    sign = -1 if mid[forward] < 0 else 1
    f = sign * points[:, forward]
    seen = points[f > config.f_min]
    f = f[f > config.f_min]
    far = f > config.d0
    if far.sum() < 50:
        far = np.ones(len(f), bool)
    u, v = (seen[far, i] * config.d0 / f[far] for i in (lateral, vertical))
    (u_lo, u_hi), (v_lo, v_hi) = (np.percentile(x, (1, 99)) + (-config.margin, config.margin) for x in (u, v))
    return (forward, sign, lateral, vertical), Grid(float(u_lo), float(u_hi), float(v_lo), float(v_hi), config.res)


def lit_codes(points: np.ndarray, axes: tuple[int, int, int, int], grid: Grid, config: ShadowConfig) -> np.ndarray:
    """Sorted codes of the cells that a frame lights, as plane_cells and z_buffer have them."""
    forward, sign, lateral, vertical = axes
    f = sign * points[:, forward]
    ahead = f > config.f_min
    f, lat, ver = f[ahead], points[ahead, lateral], points[ahead, vertical]
    u, v = lat * config.d0 / f, ver * config.d0 / f
    inside = (u >= grid.u_lo) & (u < grid.u_hi) & (v >= grid.v_lo) & (v < grid.v_hi)
    iu, iv = (((x[inside] - lo) / grid.res + 1e-6).astype(np.int64) for x, lo in ((u, grid.u_lo), (v, grid.v_lo)))
    codes = iu << 20 | iv
    order = np.lexsort((f[inside], codes))
    codes, first = np.unique(codes[order], return_index=True)
    return codes[f[inside][order][first] > config.d0]


class Primed(Ordered):
    """Phases: frames are gathered until `prime` have come; those give axes and grid, fill the ring and give the last one's result; then each frame is compared."""

    takes, gives = "x array<double>, y array<double>, z array<double>", "frame_idx long, iu int, iv int, kind string"

    def __init__(self, config: ShadowConfig):
        self.config = config

    def open(self, handle) -> None:
        self.waiting = handle.getListState("waiting", self.takes)
        self.geometry = handle.getValueState("geometry", "forward int, sign int, lateral int, vertical int, u_lo double, u_hi double, v_lo double, v_hi double")
        self.ring = handle.getListState("ring", "lit array<long>")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        config = self.config
        ring = [np.array(lit, np.int64) for (lit,) in self.ring.get()]
        known = tuple(self.geometry.get()) if self.geometry.exists() else None
        waiting = [] if known else [np.array(p, float).T for p in self.waiting.get()]
        for frame, *xyz in frames:
            points = np.array(xyz, float).T.reshape(-1, 3)
            if known is None:
                waiting.append(points)
                if len(waiting) < config.prime:
                    continue
                axes, grid = primed_geometry(np.concatenate(waiting), config)
                known = (*axes, grid.u_lo, grid.u_hi, grid.v_lo, grid.v_hi)
                self.geometry.update(known)
                ring = [lit_codes(p, axes, grid, config) for p in waiting]
                self.waiting.clear()
            else:
                axes, grid = known[:4], Grid(*known[4:], config.res)
                ring = [*ring, lit_codes(points, axes, grid, config)][-config.buffer :]
            if len(ring) >= config.window:
                yield compared(ring[-config.window :], ring[-1], config.frac).assign(frame_idx=frame)[["frame_idx", "iu", "iv", "kind"]]
        if known is None:
            self.waiting.put([tuple(p.T.tolist()) for p in waiting])
        self.ring.put([(lit.tolist(),) for lit in ring])


def primed_consensus_stream(frames: DataFrame, config: ShadowConfig = ShadowConfig(), *, late: str = LATE) -> DataFrame:
    """(bag, frame_idx, iu, iv, kind) of frames (bag, ts_ns, frame_idx, x, y, z arrays) whose axes and grid are found from the first `prime` frames of a recording.

    Of those frames only the last one gives rows. The window holds the frame itself.
    """
    return _ordered(frames, Primed(config), late)


class Tracker(Ordered):
    takes, gives = "d double, theta double", "frame_idx long, track_d double, track_theta double, streak long, reported boolean"

    def __init__(self, persist: int, gate_d: float, gate_theta: float, keep: float, reset_at: int | None):
        self.rule, self.reset_at = (persist, gate_d, gate_theta, keep), reset_at

    def open(self, handle) -> None:
        self.track = handle.getValueState("track", "d double, theta double, streak long, seen long")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        *state, seen = self.track.get() if self.track.exists() else (None, None, 0, 0)
        # What the boot phase has tracked is static scenery: the track starts anew behind it.
        cut = -1 if self.reset_at is None else self.reset_at - seen
        for part in [frames[:cut], None, frames[cut:]] if 0 <= cut < len(frames) else [frames]:
            if part is None:
                state = [None, None, 0]
            elif part:
                *out, state = tracked([d for _, d, _ in part], [t for _, _, t in part], *self.rule, tuple(state))
                yield pd.DataFrame({"frame_idx": [n for n, _, _ in part], "track_d": out[0], "track_theta": out[1], "streak": out[2], "reported": out[3]})
        self.track.update((*state, seen + len(frames)))


def tracker_stream(candidates: DataFrame, *, persist: int = 3, gate_d: float = 0.3, gate_theta: float = 4.0, keep: float = 0.8, reset_at: int | None = None, late: str = LATE) -> DataFrame:
    """track_nearest on a stream of (bag, ts_ns, frame_idx, d, theta). reset_at: frames of a recording after which the track starts anew, as when a boot phase ends."""
    return _ordered(candidates, Tracker(persist, gate_d, gate_theta, keep, reset_at), late)


class Persistence(Ordered):
    takes, gives = "x_lo array<double>, x_hi array<double>, y_lo array<double>, y_hi array<double>", "frame_idx long, box int"

    def __init__(self, lags: int, grow: float):
        self.lags, self.grow = lags, grow

    def open(self, handle) -> None:
        self.past = handle.getListState("past", "places array<double>")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        g = self.grow  # both boxes grow, each by its own edges: a sum of both would round otherwise
        touch = lambda a, b: b[0] - g <= a[1] + g and b[1] + g >= a[0] - g and b[2] - g <= a[3] + g and b[3] + g >= a[2] - g
        past, out = [np.array(p, float).reshape(-1, 4).tolist() for (p,) in self.past.get()], []
        for frame, *edges in frames:
            now = list(zip(*(e.tolist() for e in edges), strict=True))
            if len(past) == self.lags:
                out += [(frame, i) for i, b in enumerate(now) if all(any(touch(b, o) for o in before) for before in past)]
            past = [*past, now][-self.lags :]
        self.past.put([([x for b in boxes for x in b],) for boxes in past])
        if out:
            yield pd.DataFrame(out, columns=["frame_idx", "box"])


def persistence_stream(boxes: DataFrame, *, lags: int = 2, grow: float = 10.0, late: str = LATE) -> DataFrame:
    """(bag, frame_idx, box) of boxes that overlap one, both grown by `grow`, in every one of the `lags` frames before. boxes has one row a frame: (bag, ts_ns, frame_idx, boxes array<struct<x_lo, x_hi, y_lo, y_hi>>)."""
    edges = [F.transform("boxes", lambda b: b[c].cast("double")).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")]  # noqa: B023
    return _ordered(boxes.select("bag", "ts_ns", "frame_idx", *edges), Persistence(lags, grow), late)


class Ema(Ordered):
    takes, gives = "d double", "frame_idx long, ema double"

    def __init__(self, keep: float, patience: int):
        self.keep, self.patience = keep, patience

    def open(self, handle) -> None:
        self.level = handle.getValueState("level", "ema double, misses long")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        ema, misses = self.level.get() if self.level.exists() else (None, 0)
        out = []
        for frame, d in frames:
            if d is None:
                misses += 1
                ema = None if misses > self.patience else ema
            else:
                ema, misses = d if ema is None else self.keep * ema + (1 - self.keep) * d, 0
            out.append((frame, ema))
        self.level.update((ema, misses))
        yield pd.DataFrame(out, columns=["frame_idx", "ema"])


def ema_stream(rows: DataFrame, *, keep: float = 0.7, patience: int = 30, late: str = LATE) -> DataFrame:
    """ema_with_reset on a stream of (bag, ts_ns, frame_idx, d); a null d is a miss."""
    return _ordered(rows, Ema(keep, patience), late)


class BootMask(Ordered):
    takes, gives = "lit array<long>", "iu int, iv int"

    def __init__(self, boot: int, share: float, size: tuple[int, int]):
        self.boot, self.share, self.size = boot, share, size

    def near(self, lit: list[int]) -> np.ndarray:
        """Codes of the lit cells and those beside them, within the plane."""
        at = _cells(np.array(lit, np.int64))
        u, v = (np.add.outer(at[c].astype(np.int64), np.array(o)).ravel() for c, o in (("iu", [-1, -1, -1, 0, 0, 0, 1, 1, 1]), ("iv", [-1, 0, 1] * 3)))
        inside = (u >= 0) & (u < self.size[0]) & (v >= 0) & (v < self.size[1])
        return np.unique(u[inside] << 20 | v[inside])

    def open(self, handle) -> None:
        self.seen = handle.getValueState("seen", "frames long")
        self.counts = handle.getMapState("counts", "cell long", "n long")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        if seen >= self.boot:
            return
        now = frames[: self.boot - seen]
        cells, n = np.unique(np.concatenate([self.near(lit) for _, lit in now]), return_counts=True)
        for c, k in zip(cells.tolist(), n.tolist(), strict=True):
            self.counts.updateValue((c,), (k + (self.counts.getValue((c,))[0] if self.counts.containsKey((c,)) else 0),))
        self.seen.update((seen + len(now),))
        if seen + len(now) == self.boot:
            lit = np.array(sorted(k[0] for k, v in self.counts.iterator() if v[0] >= self.share * self.boot), np.int64)
            self.counts.clear()
            yield pd.DataFrame(_cells(lit))


def boot_mask_stream(frames: DataFrame, size: tuple[int, int], *, boot: int = 30, share: float = 0.25, late: str = LATE) -> DataFrame:
    """(bag, iu, iv) once a recording has had `boot` frames: cells of a plane of `size` lit, themselves or one beside them, in at least `share` of them. Then the mask is frozen."""
    return _ordered(frames, BootMask(boot, share, size), late)


class Held(Ordered):
    takes, gives = "d double", "frame_idx long, d double, computed boolean"

    def __init__(self, every: int):
        self.every = every

    def open(self, handle) -> None:
        self.latest = handle.getValueState("latest", "d double, seen long")

    def step(self, frames: list[tuple]) -> Iterator[pd.DataFrame]:
        latest, seen = self.latest.get() if self.latest.exists() else (None, 0)
        out = []
        for frame, d in frames:
            latest = d if seen % self.every == 0 else latest
            out.append((frame, latest, seen % self.every == 0))
            seen += 1
        self.latest.update((latest, seen))
        yield pd.DataFrame(out, columns=["frame_idx", "d", "computed"])


def held_stream(rows: DataFrame, *, every: int = 2, late: str = LATE) -> DataFrame:
    """(bag, frame_idx, d, computed): every `every`-th frame's d, kept for the frames between."""
    return _ordered(rows, Held(every), late)


def windowed_counts(frames: DataFrame, *, length: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Frames (bag, ts) in event-time windows with a watermark on ts; beyond what recordings need, for live feeds."""
    return frames.withWatermark("ts", late).groupBy("bag", F.window("ts", length)).agg(F.count("*").alias("frames"))


def canvas(points: DataFrame, d0: float, margin: float, res: float) -> Grid:
    """Grid that holds a whole recording, from a batch pass before the stream starts. A recording without points beyond d0 has none."""
    e = extent(points, d0, margin, least=1).first()
    if e is None or e["u_lo"] is None or not e["n_far"]:
        raise ValueError(f"no point lies beyond {d0} m, so the full canvas has no extent")
    return Grid(e["u_lo"], e["u_hi"], e["v_lo"], e["v_hi"], res)


def write_batches(stream: DataFrame, folder: str, checkpoint: str, *, kind: str = "parquet", once: bool = False) -> StreamingQuery:
    """Starts a query that writes each micro-batch (parquet, csv or json) under its number, so that a batch that is run again replaces its own files."""
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(f"{folder}/batch={number}")

    out = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if once else out).start()


def summary(written: DataFrame, keys: Iterable[str] = ("bag", "kind")) -> DataFrame:
    """What a finished run of consensus_stream has written: frames and cells by recording and kind."""
    return written.groupBy(*keys).agg(F.count_distinct("frame_idx").alias("frames"), F.count("*").alias("cells"))
