"""Writers whose tasks write parts under a folder of the job, which are put in place when all tasks have ended well."""

from __future__ import annotations

import os
import shutil
import uuid
from abc import abstractmethod
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .scratch import mounted


@dataclass
class Parts(WriterCommitMessage):
    """(part, name) of each file that a task wrote."""

    files: tuple[tuple[str, str], ...]


def pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): the rows in the order in which they come, cut where a key changes and where a batch ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        codes = np.stack([np.asarray(pc.fill_null(c.dictionary_encode().indices, -1)) for c in columns])
        starts = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)]).tolist()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield tuple(c[lo].as_py() for c in columns), batch.slice(lo, hi - lo)


class CommittedWriter(DataSourceArrowWriter):
    """One file for each key, written by one task.

    A task that fails or runs twice leaves parts that nobody moves; they go with the job's folder. A key
    that two tasks or two places of one task hold fails the job, before anything is put in place.
    With `overwrite` files of the same suffix that were there before and are not written anew are removed.
    The driver keeps the names of the files, never their content.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.root, self.overwrite = mounted(path), overwrite
        self.job = os.path.join(self.root, f"_writing-{uuid.uuid4().hex}")

    @abstractmethod
    def files(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, str]]:
        """Writes parts in folder and gives (part, name below the root) of each."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        folder = os.path.join(self.job, str(TaskContext.get().taskAttemptId()))
        os.makedirs(folder, exist_ok=True)
        return Parts(tuple(self.files(iterator, folder)))

    def commit(self, messages: list[Parts | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        twice = [name for name, n in Counter(name for _, name in files).items() if n > 1]
        if twice:
            raise ValueError(f"rows of {twice[0]} are in several places; repartition and sort by its key first")
        for part, name in files:
            os.makedirs(os.path.dirname(os.path.join(self.root, name)), exist_ok=True)
            os.replace(part, os.path.join(self.root, name))
        if self.overwrite:
            new = {os.path.join(self.root, name) for _, name in files}
            for at, _, found in os.walk(self.root):
                for old in (os.path.join(at, f) for f in found if f.endswith(self.suffix)):
                    if old not in new and not at.startswith(self.job):
                        os.remove(old)
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[Parts | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
