"""Order-dependent folds: greedy matching, suppression, trackers. One group is one recording's short list of detections, in a stated order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package


TYPES = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}


def _starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where groups of equal keys start; nulls are equal."""
    codes = np.stack([np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices, -1)) for k in keys])
    return np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)]).tolist()


def _fold(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], step, extra: str) -> DataFrame:
    """rows with the `extra` columns that step gives for each group's arrays of the columns in `uses`. A task takes many small groups at once; it never holds more than the groups of a batch, or one group."""
    ship_package(rows.sparkSession)
    added = [tuple(c.split()) for c in extra.split(",")]

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(held)
        arrays = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in uses}
        out: list[list] = [[] for _ in added]
        starts = _starts(batch, keys)
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            for column, values in zip(out, step({c: v[lo:hi] for c, v in arrays.items()}), strict=True):
                column.extend(values)
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, TYPES[t], from_pandas=True) for v, (_, t) in zip(out, added, strict=True))], names=[*batch.schema.names, *(n for n, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = _starts(batch, keys)[-1]
            goes_on = held and all(held[0].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in (batch.schema.get_field_index(c) for c in keys))
            if held and (last or not goes_on):
                # Folded with the groups that end in this batch.
                yield folded([*held, batch.slice(0, last)] if last else held)
                held = [batch.slice(last)]
            elif last:
                yield folded([batch.slice(0, last)])
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield folded(held)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    return dealt.mapInArrow(run, f"{kinds}, {extra}")


def _places(own: dict, places: list[str]):
    return zip(*(own[c].tolist() for c in places), strict=True)


def _near(p: tuple, q, within: list[float]) -> bool:
    return all(abs(a - b) <= w for a, b, w in zip(p, q, within, strict=True))


def suppressed(rows: DataFrame, keys: list[str], order: list[str], places: list[str], within: list[float]) -> DataFrame:
    """rows with `kept`: a row goes if an earlier kept one lies within all of the limits."""

    def step(own: dict):
        kept, flags = [], []
        for p in _places(own, places):
            near = any(_near(p, q, within) for q in kept)
            flags.append(not near)
            if not near:
                kept.append(p)
        return [flags]

    return _fold(rows, keys, order, places, step, "kept boolean")


def anchored_groups(rows: DataFrame, keys: list[str], order: list[str], places: list[str], within: list[float]) -> DataFrame:
    """rows with `seed`: number of the first group whose seed lies within all limits; else the row starts a group."""

    def step(own: dict):
        seeds, out = [], []
        for p in _places(own, places):
            at = next((k for k, q in enumerate(seeds) if _near(p, q, within)), None)
            if at is None:
                at = len(seeds)
                seeds.append(p)
            out.append(at)
        return [out]

    return _fold(rows, keys, order, places, step, "seed long")


def stable_objects(rows: DataFrame, keys: list[str], order: list[str], places: list[str], within: list[float]) -> DataFrame:
    """rows with `object`: first running mean (of rounded values) closer than all limits; else a new object."""

    def step(own: dict):
        means, counts, out = [], [], []
        for p in _places({c: np.round(own[c].astype(float), 2) for c in places}, places):
            at = next((k for k, q in enumerate(means) if all(abs(a - b) < w for a, b, w in zip(p, q, within, strict=True))), None)
            if at is None:
                at = len(means)
                means.append(list(p))
                counts.append(0)
            counts[at] += 1
            means[at] = [m + (x - m) / counts[at] for m, x in zip(means[at], p, strict=True)]
            out.append(at)
        return [out]

    return _fold(rows, keys, order, places, step, "object long")


def track_nearest(rows: DataFrame, keys: list[str], order: str, d: str, theta: str, *, persist: int = 3, gate_d: float = 0.3, gate_theta: float = 4.0, keep: float = 0.8) -> DataFrame:
    """rows with track_d, track_theta, streak, reported. A candidate inside both gates of the track goes on with it: the distance keeps `keep` of its own, the angle is the new one. Another starts a new track; none ends it."""
    return _fold(rows, keys, [order], [d, theta], lambda own: tracked(own[d].tolist(), own[theta].tolist(), persist, gate_d, gate_theta, keep)[:4], "track_d double, track_theta double, streak long, reported boolean")


def tracked(ds, thetas, persist: int, gate_d: float, gate_theta: float, keep: float, state: tuple | None = None):
    """Lists of the track after each candidate, and the state to go on from; shared by batch and stream."""
    at, angle, streak = state or (None, None, 0)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for d, t in zip(ds, thetas, strict=True):
        if d is None or d != d:
            at, angle, streak = None, None, 0
        else:
            turn = None if angle is None else (t - angle + 180.0) % 360.0 - 180.0
            if at is not None and abs(d - at) <= gate_d and abs(turn) <= gate_theta:
                at, angle, streak = keep * at + (1 - keep) * d, float(t), streak + 1
            else:
                at, angle, streak = float(d), float(t), 1
        for column, v in zip(out, (at, angle, streak, streak >= persist), strict=True):
            column.append(v)
    return *out, (at, angle, streak)


def rail_levels(rows: DataFrame, keys: list[str], order: str, value: str, *, gate: float = 0.25, back: int = 7, window: int = 6) -> DataFrame:
    """rows with `level`: median of the levels taken in the last `window` frames and this one. A detection that jumps by more
    than `gate` from the last level within `back` frames counts with that last level, which so enters the median again."""

    def step(own: dict):
        taken: list[tuple] = []
        out = []
        for n, v in zip(own[order].tolist(), own[value].tolist(), strict=True):
            if v is not None and v == v:
                last = next((x for k, x in reversed(taken) if n - back <= k < n), None)
                taken.append((n, v if last is None or abs(v - last) <= gate else last))
            near = sorted(x for k, x in taken if n - window <= k <= n)
            mid = len(near) // 2
            out.append(None if not near else near[mid] if len(near) % 2 else (near[mid - 1] + near[mid]) / 2)
            taken = [t for t in taken if t[0] >= n - back]
        return [out]

    return _fold(rows, keys, [order], [order, value], step, "level double")


def recursive_median(rows: DataFrame, keys: list[str], order: str, value: str, half: int = 5) -> DataFrame:
    """rows with `smooth`: running median whose left neighbours are already smoothed."""

    def step(own: dict):
        v = own[value].astype(float)
        for i in range(len(v)):
            near = sorted(v[max(0, i - half) : i + half + 1])
            mid = len(near) // 2
            v[i] = near[mid] if len(near) % 2 else (near[mid - 1] + near[mid]) / 2
        return [v]

    return _fold(rows, keys, [order], [value], step, "smooth double")
