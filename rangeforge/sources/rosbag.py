"""Recorded message streams in SQLite bags as a Spark data source: spark.read.format("rosbag").load(path)."""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..shipping import bound_batches
from .committed import CommittedWriter, pieces
from .scratch import plain

SCHEMA = "bag string, topic string, frame_idx long, ts_ns long, data binary"
#: Messages, and bytes of messages, after which a batch is given.
BATCH, BATCH_BYTES = 16, 4 << 20


@dataclass(frozen=True)
class BagTable:
    """Names of the columns in one of the two layouts; topics is set where topic names are in a table of their own."""

    topic: str
    ts: str
    data: str
    topics: bool


def open_bag(path: str) -> sqlite3.Connection:
    if not os.path.getsize(path):
        raise ValueError(f"{path} is empty")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def sniff(db: sqlite3.Connection, path: str) -> BagTable:
    columns = {r[1] for r in db.execute("PRAGMA table_info(messages)")}
    if not columns:
        raise ValueError(f"{path} has no table messages")
    pick = lambda *names: next((n for n in names if n in columns), None)
    topic, ts, data = pick("topic_id", "topic"), pick("timestamp", "ts"), pick("data", "blob")
    if not (topic and ts and data):
        raise ValueError(f"{path}: messages has columns {sorted(columns)}, which are of no known layout")
    return BagTable(topic, ts, data, topic == "topic_id")


def _messages(db: sqlite3.Connection, t: BagTable, bag: str, keys: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Messages of (number, id) keys, each fetched by its id, so that no sort carries the data."""
    name = "coalesce(t.name, '')" if t.topics else f"coalesce(m.{t.topic}, '')"
    join = "LEFT JOIN topics t ON t.id = m.topic_id" if t.topics else ""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        index, topic, ts, data = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([bag] * len(held)), pa.array(topic, pa.string()), pa.array(index, pa.int64()), pa.array(ts, pa.int64()), pa.array(data, pa.binary())], names=["bag", "topic", "frame_idx", "ts_ns", "data"])

    for index, number in keys:
        held += [(index, *row) for row in db.execute(f"SELECT {name}, m.{t.ts}, m.{t.data} FROM messages m {join} WHERE m.id = ?", (number,))]
        size += len(held[-1][3] or b"")
        if len(held) >= BATCH or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def bag_files(path: str) -> list[str]:
    """A bag, the first bag of a recording's folder, or all bags of the folders in a folder."""
    if os.path.isfile(path):
        return [path]
    own = sorted(f for f in os.listdir(path) if f.endswith(".db3"))
    if own:
        return [os.path.join(path, own[0])]
    below = (os.path.join(path, d) for d in sorted(os.listdir(path)))
    return [f for d in below if os.path.isdir(d) for f in bag_files(d)]


def bag_name(path: str, root: str) -> str:
    """The folder of a bag, or the name of the file if that is what was asked for."""
    return os.path.basename(os.path.dirname(path)) if path != root else os.path.splitext(os.path.basename(path))[0]


@dataclass
class BagRange(InputPartition):
    """Messages `first` to `first + count - 1` in the reader's order, which starts behind the message `after` (time, id)."""

    path: str
    bag: str
    first: int
    count: int
    after: tuple[int, int]


@dataclass
class RosbagReader(DataSourceReader):
    path: str
    order: str = "id"
    per_partition: int = 200
    names: tuple = ()
    tests: list[tuple[str, str, object]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        """Tests on topic and time go into the SQLite query; the others are left to Spark."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and f.attribute in (("ts_ns",), ("topic",)) and (f.attribute == ("ts_ns",) or isinstance(f, EqualTo)):
                self.tests.append((f.attribute[0], signs[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[BagRange]:
        out = []
        for path in bag_files(self.path.removeprefix("file://")):
            if self.names and not any(n in path for n in self.names):
                continue
            bag = bag_name(path, self.path)
            with open_bag(path) as db:
                t = sniff(db, path)
                # One pass over the keys finds where each range starts, so that no range skips through those before it.
                order = "id" if self.order == "id" else f"{t.ts}, id"
                keys = db.execute(f"SELECT at, ts, id FROM (SELECT row_number() OVER (ORDER BY {order}) AS at, {t.ts} AS ts, id FROM messages) WHERE at % ? = 0 ORDER BY at", (self.per_partition,)).fetchall()
                n = db.execute("SELECT count(*) FROM messages").fetchone()[0]
            starts = [(0, (-(1 << 63), -(1 << 63))), *((at, (ts, number)) for at, ts, number in keys if at < n)]
            out += [BagRange(path, bag, at, min(self.per_partition, n - at), after) for at, after in starts if at < n]
        return out or [BagRange("", "", 0, 0, (0, 0))]

    def read(self, part: BagRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with open_bag(part.path) as db:
            t = sniff(db, part.path)
            order = "id" if self.order == "id" else f"{t.ts}, id"
            name = "coalesce(t.name, '')" if t.topics else "coalesce(m.topic, '')"
            join = "LEFT JOIN topics t ON t.id = m.topic_id" if t.topics else ""
            where = " AND ".join(f"{c} {sign} ?" for c, sign, _ in self.tests) or "1"
            behind = "id > ?" if self.order == "id" else f"({t.ts}, id) > (?, ?)"
            topic = t.topic if t.topics else f"{t.topic} AS topic"
            sql = f"SELECT i + ?, id FROM (SELECT {name} AS topic, m.i, m.{t.ts} AS ts_ns, m.id FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM (SELECT id, {t.ts}, {topic} FROM messages WHERE {behind} ORDER BY {order} LIMIT ?)) m {join}) WHERE {where} ORDER BY i"
            after = part.after[1:] if self.order == "id" else part.after
            yield from _messages(db, t, part.bag, db.execute(sql, (part.first, *after, part.count, *(v for _, _, v in self.tests))).fetchall())


@dataclass
class BagSpan(InputPartition):
    """Messages of a bag with ids over `after` up to `last`."""

    path: str
    bag: str
    after: int
    last: int


@dataclass
class RosbagStreamReader(DataSourceStreamReader):
    """Messages as they are added to bags, new bags too. The offset is the last id taken of each bag, so that a batch that is run again
    reads the same messages; bags only grow, by ids that rise. Bags that are not there yet or hold no table are looked at again later."""

    path: str
    per_partition: int = 200
    names: tuple = ()

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        out = {}
        for path in bag_files(self.path) if os.path.exists(self.path) else []:
            if (self.names and not any(n in path for n in self.names)) or not os.path.getsize(path):
                continue
            with contextlib.closing(open_bag(path)) as db:
                if db.execute("SELECT 1 FROM sqlite_master WHERE name = 'messages'").fetchone():
                    last = db.execute("SELECT max(id) FROM messages").fetchone()[0]
                    out |= {} if last is None else {path: last}
        return out

    def partitions(self, start: dict, end: dict) -> list[BagSpan]:
        spans = ((path, start.get(path, 0), last) for path, last in sorted(end.items()))
        return [BagSpan(path, bag_name(path, self.path), lo, min(lo + self.per_partition, last)) for path, first, last in spans for lo in range(first, last, self.per_partition)]

    def read(self, part: BagSpan) -> Iterator[pa.RecordBatch]:
        with contextlib.closing(open_bag(part.path)) as db:
            t = sniff(db, part.path)
            before = db.execute("SELECT count(*) FROM messages WHERE id <= ?", (part.after,)).fetchone()[0]
            yield from _messages(db, t, part.bag, db.execute("SELECT row_number() OVER (ORDER BY id) - 1 + ?, id FROM messages WHERE id > ? AND id <= ? ORDER BY id", (before, part.after, part.last)).fetchall())


class RosbagWriter(CommittedWriter):
    """One bag is one file and so one task; it holds no more of it than a batch."""

    suffix = ".db3"

    def files(self, batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, str]]:
        for k, ((bag,), group) in enumerate(groupby(pieces(batches, ("bag",)), itemgetter(0))):
            if bag is None:
                raise ValueError("messages to be written need a bag")
            part = os.path.join(folder, f"{k}.part")
            topics: dict = {}
            with contextlib.closing(sqlite3.connect(part)) as db:
                db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT)")
                db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
                for _, piece in group:
                    columns = [piece.column(piece.schema.get_field_index(c)) for c in ("topic", "ts_ns", "data")]
                    rows = ([c[row].as_py() for c in columns] for row in range(piece.num_rows))
                    db.executemany("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", ((topics.setdefault(t, len(topics) + 1), ts, d) for t, ts, d in rows))
                db.executemany("INSERT INTO topics VALUES (?, ?)", ((n, t) for t, n in topics.items()))
                db.commit()
            yield part, f"{bag}/{bag}.db3"


class RosbagSource(DataSource):
    """Options: path; orderBy = id or timestamp (batch reads); rowsPerPartition; bags = comma-separated parts of paths to keep. Streams go by id.

    Written rows are the messages of bags, those of a bag together and in order; <bag>/<bag>.db3 is one bag. Null topics
    come back as '', null times and data as null.
    """

    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RosbagReader:
        o = self.options
        if o.get("orderBy", "id") not in ("id", "timestamp"):
            raise ValueError('orderBy must be "id" or "timestamp"')
        return RosbagReader(o["path"], o.get("orderBy", "id"), int(o.get("rowsPerPartition", "200")), tuple(x for x in o.get("bags", "").split(",") if x))

    def streamReader(self, schema) -> RosbagStreamReader:  # noqa: N802  Spark's name
        o = self.options
        if o.get("orderBy", "id") != "id":
            raise ValueError("a stream of bags goes by id")
        return RosbagStreamReader(o["path"].removeprefix("file://"), int(o.get("rowsPerPartition", "200")), tuple(x for x in o.get("bags", "").split(",") if x))

    def writer(self, schema, overwrite: bool) -> RosbagWriter:
        missing = {"bag", "topic", "ts_ns", "data"} - set(schema.names)
        if missing:
            raise ValueError(f"bags need the columns {sorted(missing)}")
        return RosbagWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    bound_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RosbagSource)


def write_bags(messages: DataFrame, folder: str, mode: str = "append") -> list[str]:
    """Writes messages (bag, topic, frame_idx, ts_ns, data) as folder/<bag>/<bag>.db3, in the order of frame_idx, all bags or none; gives the paths of all bags there."""
    register(messages.sparkSession)
    rows = messages.select("bag", "topic", "frame_idx", "ts_ns", "data").repartition("bag").sortWithinPartitions("bag", "frame_idx")
    rows.write.format("rosbag").mode(mode).save(folder)
    return bag_files(plain(folder))
