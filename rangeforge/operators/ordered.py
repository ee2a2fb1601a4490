"""Groups of rows in order: dealt by their keys, sorted within partitions by the engine (which may spill), and taken many groups a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship_package


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which a group begins; the first row is one."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, starts) of whole groups; only a group that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        first, end = ([batch.column(batch.schema.get_field_index(k))[int(i)].as_py() for k in keys] for i in (0, batch.num_rows - 1))
        if held and first != last:
            rows = pa.concat_batches(held)
            yield rows, np.zeros(1, np.int64)
            held = []
        cut = int(starts[-1])
        if cut:
            rows = pa.concat_batches([*held, batch.slice(0, cut)])
            yield rows, _starts(rows, keys)
            held = []
        held.append(batch.slice(cut))
        last = end
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64)


def added(rows: DataFrame, keys: list[str], order: list[str], takes: list[str], make: Callable[..., list], extra: str) -> DataFrame:
    """rows with the columns `extra` that make(columns of a group in order) gives, as lists or arrays; one group at a time must fit a task's memory."""
    ship_package(rows.sparkSession)
    names = [c.strip().split()[0] for c in extra.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, keys):
            columns = [batch.column(batch.schema.get_field_index(c)).to_pandas() for c in takes]
            parts = [make(*(c.iloc[a:b] for c in columns)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True)]
            new = [pa.array([x for part in parts for x in part[k]], from_pandas=True) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, {extra}")


def carried(rows: DataFrame, keys: list[str], order: list[str], takes: list[str], start: Callable[[], object], step: Callable, extra: str) -> DataFrame:
    """rows with the column `extra` that step(state, values...) -> (state, value) gives row by row; only the state is carried on, so a group may be of any size."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = set(_starts(batch, keys).tolist())
            at = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            values, out = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in takes], []
            for i, row in enumerate(zip(*values, strict=True)):
                if i in starts and (key := [c[i].as_py() for c in at]) != own:
                    own, state = key, start()
                state, value = step(state, *row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, extra.split()[0]])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, {extra}")
