"""Exact removal of repeated passages, after prefix-free parsing.

A byte string of LENGTH that starts in two places is found without sorting all
suffixes. Rolling-hash triggers create phrases: of the grams in the first part of
a window the one with the least hash is its trigger, so equal windows have equal
triggers wherever they stand. The windows of one trigger form a phrase, taken
with all the bytes they cover. Distinct phrases are the dictionary, their
occurrences the parse:

1. Phrases seen twice in the corpus: all their windows are repeated.
2. Phrases seen once whose trigger block stands in no other phrase: no window
   of theirs is repeated.
3. Of the others, each distinct phrase gives its windows once a task to a
   dictionary of suffixes, put in order by a digest of their first LENGTH bytes;
   equal neighbours in that order are repeated. Equality is all that is asked,
   so digest order takes the place of byte order.

Every count is taken in parts first, phrases and windows by some million of a
task, so that a passage that stands in a third of all texts sends a few rows a
task.
Texts travel once, in compressed blocks of some hundred kilobytes; what is known
of a block's phrases and windows comes to it by its number.

Digests are made of two polynomial hashes with random byte values: 128 bits for
phrases, which are digested whole, and 96 for windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, table, text_or_empty

LENGTH = 200
GRAM = 8
#: Bytes looked at together; longer texts are taken in overlapping parts.
PART = 1 << 19
#: Bytes of texts in a block; a longer text is a block of its own.
BLOCK = 1 << 17
#: Windows that a task sorts and packs together; bytes of texts to a lane of the windows' order.
PACK, LANE = 1 << 20, 1 << 22
_PLACE = np.uint64((1 << 20) - 1)
_ODD = np.random.default_rng(99).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Random byte values, powers and inverse powers of two odd bases modulo 2^64."""
    values = [np.random.default_rng(s).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(s & 1) for s in (7, 8)]
    n, powers, inverses = PART + 4096, [], []
    for base in (int(_ODD[5]) | 5, int(_ODD[6]) | 3):
        inverse = pow(base, -1, 1 << 64)
        for out, x in ((powers, base), (inverses, inverse)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
    return values, powers, inverses


def _mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[k]
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Shape:
    """length: of a repeated string; block: bytes from a trigger on that are compared first; part, texts and pack: bounds on what is looked at and packed together."""

    length: int = LENGTH
    part: int = PART
    texts: int = BLOCK
    pack: int = PACK

    @property
    def block(self) -> int:
        return max(GRAM, self.length * 24 // 100)

    @property
    def reach(self) -> int:
        """Places in a window where its trigger may stand."""
        return self.length - self.block + 1


class Part:
    """Digests of byte ranges of texts that stand one after another."""

    def __init__(self, texts: list[bytes], shape: Shape):
        self.shape = shape
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = b"".join(texts)
        self.n = n = len(self.raw)
        data = np.frombuffer(self.raw, np.uint8)
        values, powers, self.inverses = _tables()
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v[data] * p[:n])]) for v, p in zip(values, powers, strict=True)]

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = ((s[hi] - s[lo]) * i[lo] for s, i in zip(self.sums, self.inverses, strict=True))
        return _mix(a ^ _mix(b, 1), 2), _mix(b ^ _mix(a, 5), 6)

    def phrases(self) -> tuple[np.ndarray, ...]:
        """(text, first window, last window, trigger, both phrase digests, block digest); windows and triggers by their place in the text."""
        n, length, reach = self.n, self.shape.length, self.shape.reach
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none, none, *[none.astype(np.uint64)] * 3
        grams = np.ndarray((n,), "<u8", self.raw + bytes(GRAM), strides=(1,))
        least = (_mix(grams * _ODD[3], 4) & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if reach > width:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(n - length + 1)
        at = at[owner[at] == owner[at + length - 1]]
        if not len(at):
            return none, none, none, none, *[none.astype(np.uint64)] * 3
        trigger = (least[at] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]))
        first, last, trigger = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], trigger[new]
        place = (trigger - first).astype(np.uint64) * _ODD[0] + (last - first).astype(np.uint64) * _ODD[1]
        phrase = [_mix(d + place, 3) for d in self.digests(first, last + length)]
        text = owner[first]
        base = self.starts[text]
        return text, first - base, last - base, trigger - base, *phrase, self.digests(trigger, trigger + self.shape.block)[0]


def _parts(texts: list[bytes], shape: Shape) -> Iterator[tuple[list[int], list[int], Part]]:
    """(text numbers, offsets, Part): texts together up to PART bytes; parts of a longer text overlap by length - 1."""
    numbers, offsets, held, size = [], [], [], 0
    for k, text in enumerate(texts):
        step = shape.part - shape.length
        for lo in range(0, max(1, len(text) - shape.length + 1), step):
            piece = text[lo : lo + step + shape.length - 1]
            if held and size + len(piece) > shape.part:
                yield numbers, offsets, Part(held, shape)
                numbers, offsets, held, size = [], [], [], 0
            numbers.append(k)
            offsets.append(lo)
            held.append(piece)
            size += len(piece)
    if held:
        yield numbers, offsets, Part(held, shape)


class Block:
    """Texts that follow one another in a task's rows, with the byte at which each begins."""

    def __init__(self, doc_ids: list, raws: list[bytes], shape: Shape):
        self.doc_ids, self.raws, self.shape = doc_ids, raws, shape
        self.base = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)

    def parts(self) -> Iterator[tuple[np.ndarray, Part]]:
        """(shift, Part): shift[k] leads from a place in the part's k-th text to the place in the block."""
        for numbers, offsets, part in _parts(self.raws, self.shape):
            yield self.base[numbers] + np.array(offsets, np.int64), part


def _blocks(batches: Iterable[pa.RecordBatch], shape: Shape) -> Iterator[tuple[int, Block]]:
    """Numbered blocks of a task's rows (doc_id, text); they don't depend on how rows come in batches."""
    number, ids, raws, size = TaskContext.get().partitionId() << 33, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode() if text else b""
            if raws and size + len(raw) > shape.texts:
                yield number, Block(ids, raws, shape)
                number, ids, raws, size = number + 1, [], [], 0
            ids.append(doc_id)
            raws.append(raw)
            size += len(raw)
    if raws:
        yield number, Block(ids, raws, shape)


def _dictionary(docs: DataFrame, shape: Shape) -> DataFrame:
    """(t, u, b, n, blocks): distinct phrases of some consecutive blocks and the blocks that hold them; n is 2 for one that stands there more than once."""

    def counted(held: list[tuple]) -> pa.RecordBatch:
        t, u, b, block = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(t, kind="stable")
        t, u, b, block = t[order], u[order], b[order], block[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        first = np.flatnonzero(new)
        n = np.minimum(np.diff(np.append(first, len(t))), 2).astype(np.int32)
        kept = new | np.concatenate([[True], block[1:] != block[:-1]])
        starts = np.append(np.cumsum(kept)[first] - 1, kept.sum()).astype(np.int32)
        blocks = pa.ListArray.from_arrays(pa.array(starts), pa.array(block[kept]))
        return pa.RecordBatch.from_arrays([pa.array(t[first].view(np.int64)), pa.array(u[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n), blocks], names=["t", "u", "b", "n", "blocks"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for number, block in _blocks(batches, shape):
            for _, part in block.parts():
                t, u, b = part.phrases()[4:]
                held.append((t, u, b, np.full(len(t), number)))
                size += len(t)
            if size > shape.pack:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return docs.mapInArrow(gather, "t long, u long, b long, n int, blocks array<long>")


def _marks(docs: DataFrame, shape: Shape) -> DataFrame:
    """(block, repeated, shared): phrases of a block that are repeated, and those whose trigger block other phrases have too.

    Phrases are dealt by their trigger block, so one exchange serves both
    counts. What a task holds more than once has been counted there.
    """
    same_b, same_t = Window.partitionBy("b"), Window.partitionBy("b", "t", "u")
    told = (
        _dictionary(docs, shape)
        .repartition("b")
        .withColumns({"copies": F.sum("n").over(same_t), "kind": F.dense_rank().over(same_b.orderBy("t", "u"))})
        .withColumn("kinds", F.max("kind").over(same_b))
        .where("copies > 1 OR kinds > 1")
        .select("t", "copies", "kinds", F.explode("blocks").alias("block"))
    )
    pick = lambda test: F.collect_list(F.when(test, F.col("t")))
    return told.groupBy("block").agg(pick(F.col("copies") > 1).alias("repeated"), pick(F.col("kinds") > 1).alias("shared"))


def _texts(docs: DataFrame, shape: Shape) -> DataFrame:
    """(block, ids, sizes, z): each block's texts, compressed together."""
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for number, block in _blocks(batches, shape):
            columns = [pa.array([number]), pa.array([block.doc_ids], pa.list_(id_type)), pa.array([[len(r) for r in block.raws]], pa.list_(pa.int64())), pa.array([z.compress(b"".join(block.raws))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "sizes", "z"])

    return docs.mapInArrow(shrink, f"block long, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, sizes array<long>, z binary")


def _unpacked(batches: Iterable[pa.RecordBatch], shape: Shape) -> Iterator[tuple[int, Block, list[np.ndarray]]]:
    """(number, Block, further columns) of rows (block, ids, sizes, z, arrays of numbers)."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for number, ids, sizes, data, *more in zip(*batch.columns, strict=True):
            raw, ends = z.decompress(data.as_py()), np.cumsum(sizes.as_py())
            block = Block(ids.as_py(), [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.as_py(), strict=True)], shape)
            yield number.as_py(), block, [np.array(m.as_py() or [], np.int64) for m in more]


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.isin(values.view(np.int64), known)


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of numbers by place, so that those that are alike stand together."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _numbers(data: bytes, count: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, count).T).view(kind).ravel()


def _pack(w: np.ndarray, x: np.ndarray, block: np.ndarray, at: np.ndarray, lanes: int) -> pa.RecordBatch:
    """Windows in digest order, those that are alike once, cut into lanes by their first bits and packed: steps of digests, places in a table of blocks, offsets.

    Windows that are alike here are known to be repeated: they go by their
    blocks to lanes behind the others.
    """
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    order = np.argsort(w, kind="stable")
    if (w[order][1:] == w[order][:-1])[x[order][1:] != x[order][:-1]].any():
        order = np.lexsort((x, w))
    w, x, block, at = w[order], x[order], block[order], at[order].astype(np.uint32)
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])])
    first = np.flatnonzero(new)
    alone = np.diff(np.append(first, len(w))) == 1
    known = np.repeat(~alone, np.diff(np.append(first, len(w)))) & (block >= 0)
    names, blobs = [], []
    own = np.where(known, lanes + block % lanes, -1)[known]
    by_lane = np.argsort(own, kind="stable")
    own, hit_block, hit_at = own[by_lane], block[known][by_lane], at[known][by_lane]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        names.append(int(own[lo]))
        blobs.append(z.compress(np.int64(hi - lo).tobytes() + hit_block[lo:hi].tobytes() + hit_at[lo:hi].tobytes()))
    w, x, at, block = w[first], x[first], at[first], np.where(alone, block[first], -1)
    lane = ((w >> np.uint64(32)) * np.uint64(lanes) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(lane, np.arange(lanes + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        lo, hi = cuts[k], cuts[k + 1]
        tell, place = np.unique(block[lo:hi], return_inverse=True)
        steps = np.diff(w[lo:hi], prepend=np.uint64(0))
        names.append(k)
        blobs.append(z.compress(np.array([hi - lo, len(tell)], np.int64).tobytes() + tell.tobytes() + _planes(steps) + _planes(place.astype(np.uint32)) + _planes(at[lo:hi]) + x[lo:hi].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["lane", "windows"])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n, blocks = np.frombuffer(data, np.int64, 2)
    known, at = np.frombuffer(data, np.int64, blocks, 16), 16 + 8 * int(blocks)
    n = int(n)
    w = np.cumsum(_numbers(data[at : at + 8 * n], n, "<u8"))
    place = _numbers(data[at + 8 * n : at + 12 * n], n, "<u4")
    return w, np.frombuffer(data, np.uint32, n, at + 16 * n), known[place], _numbers(data[at + 12 * n : at + 16 * n], n, "<u4").astype(np.int64)


def _unpack_known(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n).astype(np.int64)


def _windows(marked: DataFrame, shape: Shape, lanes: int) -> DataFrame:
    """(lane, windows): windows of shared phrases; those of repeated phrases, which need no answer, as block -1."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, told = [], 0, set()
        for number, block, (repeated, shared) in _unpacked(batches, shape):
            for shift, part in block.parts():
                text, lo, hi, _, t, _, _ = part.phrases()
                open_, again = _in(t, shared), _in(t, repeated)
                # A repeated phrase needs no answer and is sent once a task.
                fresh = [k for k in np.flatnonzero(open_ & again).tolist() if t[k] not in told and not told.add(t[k])]
                chosen = np.sort(np.concatenate([np.flatnonzero(open_ & ~again), np.array(fresh, np.int64)]))
                if not len(chosen):
                    continue
                count = (hi - lo + 1)[chosen]
                first = lo[chosen] + part.starts[text[chosen]]
                at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                whose, named = np.repeat(text[chosen], count), np.repeat(~again[chosen], count)
                w, x = part.digests(at, at + shape.length)
                held.append((w, (x >> np.uint64(32)).astype(np.uint32), np.where(named, number, -1), np.where(named, at - part.starts[whose] + shift[whose], 0)))
                size += len(at)
            if size > shape.pack:
                yield _pack(*(np.concatenate(c) for c in zip(*held, strict=True)), lanes)
                held, size, told = [], 0, told if len(told) < shape.pack else set()
        if held:
            yield _pack(*(np.concatenate(c) for c in zip(*held, strict=True)), lanes)

    return marked.mapInArrow(suffixes, "lane long, windows binary")


def _repeated(windows: DataFrame, lanes: int) -> DataFrame:
    """(block, ats): windows with an equal neighbour in the digest order of their lane, and those known already."""

    def equal_neighbours(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w, x, block, at = (np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True))
        order = np.lexsort((x, w))
        w, x = w[order], x[order]
        same = np.concatenate([[False], (w[1:] == w[:-1]) & (x[1:] == x[:-1]), [False]])
        hit = order[(same[1:] | same[:-1]) & (block[order] >= 0)]
        return block[hit], at[hit]

    def by_block(hits: list[tuple]) -> pa.RecordBatch:
        block, at = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.argsort(block, kind="stable")
        known, first = np.unique(block[order], return_index=True)
        ats = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(at[order]))
        return pa.RecordBatch.from_arrays([pa.array(known), ats], names=["block", "ats"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lane, hits, size = [], None, [], 0
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != lane and held:
                    hits.append(equal_neighbours(held))
                    held, size = [], size + len(hits[-1][0])
                lane = own
                if own >= lanes:
                    hits.append(_unpack_known(blob))
                    size += len(hits[-1][0])
                else:
                    held.append(blob)
                if size > PACK:
                    yield by_block(hits)
                    hits, size = [], 0
        if held:
            hits.append(equal_neighbours(held))
        if hits:
            yield by_block(hits)

    return windows.repartition("lane").sortWithinPartitions("lane").mapInArrow(compare, "block long, ats array<long>")


def cut_repeats(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs: removed byte runs, and the bytes left.

    A byte goes if a string of shape.length bytes that covers it starts anywhere
    else too, in the same text or in another; strings never cross texts. Null
    counts as empty; short texts stay whole. Repeated rows repeat each other's
    bytes, so all of them go. Other columns are left out. docs should be a scan
    or a checkpoint, so that its rows come in the same order when read again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    lanes = 64 + int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // LANE
    texts = _texts(docs, shape)
    marked = texts.join(_marks(docs, shape), "block", "left").select("block", "ids", "sizes", "z", "repeated", "shared")
    hits = _repeated(_windows(marked, shape, lanes), lanes).groupBy("block").agg(F.flatten(F.collect_list("ats")).alias("ats"))

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, (repeated, ats) in _unpacked(batches, shape):
            edge = np.zeros(int(block.base[-1]) + 1, np.int64)
            if len(repeated):
                for shift, part in block.parts():
                    text, lo, hi, _, t, _, _ = part.phrases()
                    own = np.flatnonzero(_in(t, repeated))
                    np.add.at(edge, (lo + shift[text])[own], 1)
                    np.add.at(edge, (hi + shift[text])[own] + shape.length, -1)
            np.add.at(edge, ats, 1)
            np.add.at(edge, ats + shape.length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            rows = []
            for doc_id, raw, lo in zip(block.doc_ids, block.raws, block.base.tolist(), strict=False):
                own = gone[lo : lo + len(raw)]
                if own.any():
                    turns = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                    rows.append((doc_id, len(raw), [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)], np.frombuffer(raw, np.uint8)[~own].tobytes()))
                else:
                    rows.append((doc_id, len(raw), [], raw))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1]), pa.array(columns[2], _SPANS), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = marked.join(hits, "block", "left").select("block", "ids", "sizes", "z", "repeated", "ats")
    return joined.mapInArrow(remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b)::BIGINT AS n FROM d),
i AS (SELECT rid, b, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200),
w AS (SELECT rid, i, md5(array_slice(b, i + 1, i + 200)) AS s FROM i),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
g AS (SELECT rid, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, min(i) AS a, max(i) + 200 AS e FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM g) GROUP BY rid, k),
p AS (SELECT rid, coalesce(lag(e) OVER o, 0) AS lo, a AS hi, e FROM s WINDOW o AS (PARTITION BY rid ORDER BY a)),
k AS (SELECT rid, lo, hi FROM p UNION ALL SELECT n.rid, coalesce(max(p.e), 0), n.n FROM n LEFT JOIN p USING (rid) GROUP BY n.rid, n.n),
t AS (SELECT k.rid, sha256(unhex(string_agg(hex(array_slice(b, lo + 1, hi)), '' ORDER BY lo))) AS kept_sha256 FROM k JOIN n USING (rid) GROUP BY k.rid),
c AS (SELECT rid, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM n JOIN t USING (rid) LEFT JOIN c USING (rid)
"""
