"""Jaccard similarity join of shingle sets as a grouped prefix join.

Equal sets are one node. Shingles have one order over the whole corpus: those
that many documents share come last, all others by their hash. Two sets of
similarity t share one of the first n - ceil(t n) + 1 shingles of each, the
prefix, and their sizes differ by a factor of t at most.

1. Nodes of equal prefix and size are one group. Only groups are listed under
   the shingles of their prefix; a shingle that one group alone lists is dropped.
   Long sets would meet by chance in a prefix of thousands, so for classes of
   sizes over LONG the order is by exact counts within the class, rarest first,
   and each of these sets is a group of its own.
2. Each member of a group is measured against the group's first one, and each
   group's first one against the group that most of its shingles' lists begin
   with: two candidates a node at most, whatever the size of a list. This joins
   most of what belongs together.
3. Lists that hold nodes of two components are expanded to members. They are cut
   in blocks, so that a task holds a bounded part of a list, and nodes outside a
   list's largest component meet its other nodes. A pair within a component needs
   no check. Candidates must pass a parity sketch, which never rejects a link:
   two sketches differ in no more bits than the sets in shingles. First each node
   gives its closest candidate in another component; then, after what that
   joined, all candidates between different components are checked.

Every check is made on the whole sets, of 64-bit hashes, as integers: t is given
in percent. Which shingles come last only moves work, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, joined_by_hot_keys, small_batches, table
from .components import component_roots

WORDS, PERCENT = 3, 90
#: Bits of the parity sketch.
PARITY = 1024
#: Shingles that come last in the order, at most, and hashes that a task counts together to find them.
HOT, COUNTED = 1 << 21, 1 << 22
#: Sets of classes of sizes from this one's on are listed in the order of exact counts.
LONG = 3500
#: Rows of a list that lie in one block.
BLOCK = 2048
#: Rows of lists that are taken together in a task.
ROWS_AT_ONCE = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order; a text of fewer words is one shingle, one without words has none.

    Each different word is hashed once a batch (XXH64), and a shingle's hash is made of its words'.
    """
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(split)
    spoken = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(spoken)])[np.concatenate([[0], np.cumsum(lengths)])]
    coded = flat.dictionary_encode()
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    word = hashed[coded.indices.to_numpy()[spoken]] if len(hashed) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            runs = _mixed(runs + word[k : k + len(runs)] + np.uint64(k))
        sets = []
        for lo, hi in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            if hi - lo >= words:
                sets.append(np.unique(runs[lo : hi - words + 1]))
            else:
                h = np.full(min(1, hi - lo), hi - lo, np.uint64)
                for w in word[lo:hi]:
                    h = _mixed(h * _MIX + w)
                sets.append(h)
    return sets


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first shingles of a set of n meet any set of the similarity."""
    return n - (n * percent + 99) // 100 + 1


def _parity(h: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        places = (h * _MIX) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8), bitorder="little").tobytes()


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, size, digest) of rows (text, doc_id, row), digest null for empty sets; and rows without any of these whose `often` holds (hash, count) of what a task has met often."""
    small_batches(rows.sparkSession)

    def often(held: list[np.ndarray]) -> np.ndarray:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        return np.stack([found.view(np.int64), times], axis=1)[times > 2]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["doc_id", "row", "size", "digest", "often"], [], 0
        schema = None

        def counted() -> Iterator[pa.RecordBatch]:
            if held and len(x := often(held)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(1).type), *(pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array([x.tobytes()], pa.binary())], names=names)

        for batch in batches:
            schema = batch.schema
            sets = shingle_sets(batch.column(0), words)
            digests = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(sets), pa.binary())], names=names)
            held += sets
            n += sum(map(len, sets))
            if n >= COUNTED:
                yield from counted()
                held.clear()
                n = 0
        yield from counted()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("text", "doc_id", "row").mapInArrow(measure, f"doc_id {kind}, row long, size long, digest binary, often binary")


def _hot_shingles(prints: DataFrame, most: int) -> np.ndarray:
    """The at most `most` shingles met most often, ordered by hash."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                pairs = np.frombuffer(x, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hash", "times"])

    times = prints.where(F.col("often").isNotNull()).select("often").mapInArrow(unpack, "hash long, times long").groupBy("hash").agg(F.sum("times").alias("times"))
    # Counts add up to the number of all shingles at most, so fewer than `most` reach that number's part of one in `most`.
    total = prints.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found = times.where(F.col("times") >= max(16, -(-total // most))).select("hash").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64)) if found.num_rows else np.zeros(0, np.uint64)


def _prefixes(rows: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """(row, prefix, parity, whole) of rows (text, row); prefix is packed hashes, in the corpus's order, whole all of them where a long class lists the set, else null. hot: a broadcast of the shingles that come last."""
    least = LONG

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value
        for batch in batches:
            prefixes, parities, wholes = [], [], []
            for h in shingle_sets(batch.column(0), words):
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
                prefixes.append(np.concatenate([h[~late], h[late]])[: prefix_length(len(h), percent)].tobytes() if len(h) else b"")
                parities.append(_parity(h))
                wholes.append(h.tobytes() if len(h) and _listed_in(np.array([len(h)]), percent)[1][0] >= _long_class(least, percent) else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.binary()) for x in (prefixes, parities, wholes))], names=["row", "prefix", "parity", "whole"])

    return rows.select("text", "row").mapInArrow(measure, "row long, prefix binary, parity binary, whole binary")


def _size_classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes, each four factors of the similarity wide."""
    return np.floor(np.log(n) / np.log(100 / percent) / 4 + 1e-9).astype(np.int64) if percent < 100 else n


def _listed_in(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each size, and that of its largest partner: the sets are listed in both."""
    return _size_classes(n, percent), _size_classes(n * 100 // percent, percent)


def _long_class(least: int, percent: int) -> int:
    return int(_size_classes(np.array([least]), percent)[0])


def _spread(batches: Iterator[pa.RecordBatch], percent: int, classes) -> Iterator[pa.RecordBatch]:
    """(key, grp, size) of batches (grp, size, packed hashes): a key for each hash and class that the size is listed in, of those that classes(them) tells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(1).to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        at = np.repeat(np.arange(len(own)), [len(x) for x in own])
        low, high = _listed_in(size, percent)
        ours, more = np.flatnonzero(classes(low)[at]), np.flatnonzero(((high > low) & classes(high))[at])
        shingle, kind, at = np.concatenate(own), np.concatenate([low[at[ours]], high[at[more]]]), np.concatenate([at[ours], at[more]])
        with np.errstate(over="ignore"):
            keys = _mixed(np.concatenate([shingle[ours], shingle[more]]) ^ (kind.astype(np.uint64) * _MIX))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(batch.column(0).to_numpy()[at]), pa.array(size[at]), pa.array(kind)], names=["key", "grp", "size", "class"])


def _lists(groups: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """(key, grp, size): a key for each shingle of the prefix and class of sizes. groups: (grp, size, prefix); long: (node, size, whole)."""
    first, columns = _long_class(LONG, percent), "key long, grp long, size long, class long"
    short = groups.select("grp", "size", "prefix").mapInArrow(lambda batches: _spread(batches, percent, lambda c: c < first), columns)
    every = long.select("node", "size", "whole").mapInArrow(lambda batches: _spread(batches, percent, lambda c: c >= first), columns)
    counts = every.groupBy("key").agg(F.count("*").alias("total")).where("total > 1")
    # A shingle of this set alone comes before all others and meets nothing. What is left of the prefix is taken from the others, rarest first.
    shared = joined_by_hot_keys(every, cut(counts), "key", "total")
    own = Window.partitionBy("grp", "class")
    ranked = shared.withColumns({"others": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("total", "key"))})
    prefix = F.col("size") - F.expr(f"(size * {percent} + 99) div 100") + 1
    return short.select("key", "grp", "size").union(ranked.where(F.col("rank") <= prefix - (F.col("size") - F.col("others"))).select("key", "grp", "size"))


def _first_of_lists(lists: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each group the one that most of its lists begin with, sizes allowing. Lists are dealt by ranges, so that a long one may lie in many tasks."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = size = None
        for batch in batches:
            u, v = [], []
            for k, g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A size that the list's first one can't have begins anew; the list goes on in order of the mixed number, not of size.
                if k != key or min(n, size) * 100 < percent * max(n, size):
                    key, first, size = k, g, n
                else:
                    u.append(g)
                    v.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    ordered = lists.withColumn("mixed", F.xxhash64("grp"))
    dealt = ordered.repartitionByRange("key", "mixed").sortWithinPartitions("key", "mixed").select("key", "grp", "size").mapInArrow(begin, "u long, v long")
    times = dealt.where("u != v").groupBy("u", "v").agg(F.count("*").alias("times"))
    return times.groupBy("u").agg(F.max(F.struct("times", "v")).alias("best")).select("u", F.col("best.v").alias("v"))


def _cells(listed: DataFrame, shared: DataFrame) -> DataFrame:
    """(cell, node, size, part) of lists (key, node, size, part) that hold two parts at least.

    shared has (key, total, main, most): rows of a list, its largest part and
    that part's rows. Blocks of the other rows meet one another and the blocks of
    the largest part, a cell each.
    """
    outside = F.ceil((F.col("total") - F.col("most")) / BLOCK)
    whole = F.col("total") <= 2 * BLOCK
    is_main = F.col("part") == F.col("main")
    rows = joined_by_hot_keys(listed, shared, "key", "total").withColumns({"outs": outside, "mains": F.ceil(F.col("most") / BLOCK)})
    block = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("outs")))
    other = F.sequence(F.lit(0).cast("long"), F.col("outs") - 1)
    # Cells of two blocks of other rows are named with the lower one first; those with a block of the largest part by it, counted after them.
    with_out = F.transform(other, lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda m: F.struct(F.col("block").alias("a"), (F.col("outs") + m).alias("b")))
    of_main = F.transform(other, lambda o: F.struct(o.alias("a"), (F.col("outs") + F.col("block")).alias("b")))
    places = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))).when(is_main, of_main).otherwise(F.concat(with_out, with_main))
    dealt = rows.withColumn("block", block).withColumn("place", F.explode(places))
    return dealt.select(F.when(whole, F.col("key")).otherwise(F.xxhash64("key", "place.a", "place.b")).alias("cell"), "node", "size", "part")


def _pairs_in(cell: np.ndarray, size: np.ndarray, part: np.ndarray, parity: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits of 4096 shingles) of rows of one cell that are of different parts and may link; rows are in order of cell and size, and all pairs at one distance in the table are looked at together."""
    live, d = np.arange(len(cell)), 1
    while len(live):
        live = live[live + d < len(cell)]
        live = live[cell[live] == cell[live + d]]
        # Sizes ascend, so once a partner is too large all later ones are.
        live = live[size[live] * 100 >= percent * size[live + d]]
        i = live[part[live] != part[live + d]]
        for k in range(0, len(i), 1 << 15):
            a = i[k : k + (1 << 15)]
            apart = np.bitwise_count(parity[a] ^ parity[a + d]).sum(axis=1, dtype=np.int64)
            both = size[a] + size[a + d]
            near = apart * (100 + percent) <= (100 - percent) * both
            if near.any():
                yield a[near], a[near] + d, apart[near] * 4096 // both[near]
        d += 1


def _candidates(cells: DataFrame, percent: int, *, best: bool) -> DataFrame:
    """(u, v): candidates across parts of cells (cell, node, size, part, parity), all of them or the closest of each node."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([*(batch.column(k).to_numpy() for k in range(4)), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)])
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE and held[0][0][0] != held[-1][0][-1]:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(whole[0], whole[0][-1]))
                yield tuple(c[:end] for c in whole)
                held, rows = [[c[end:] for c in whole]], len(whole[0]) - end
        if held:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, size, part, parity in cells_of(batches):
            closest, least = np.full(len(node), -1), np.full(len(node), np.iinfo(np.int64).max)
            for i, j, d in _pairs_in(cell, size, part, parity, percent):
                if not best:
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(d)], names=["u", "v", "d"])
                    continue
                for a, b in ((i, j), (j, i)):  # each side once at most at one distance
                    nearer = d < least[a]
                    least[a[nearer]], closest[a[nearer]] = d[nearer], b[nearer]
            if best and len(i := np.flatnonzero(closest >= 0)):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[closest[i]]), pa.array(least[i])], names=["u", "v", "d"])

    found = cells.repartition("cell").sortWithinPartitions("cell", "size", "node").select("cell", "node", "size", "part", "parity").mapInArrow(compare, "u long, v long, d long")
    if best:
        found = found.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    return found.select("u", "v")


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that link, by their whole sets (node, shingles)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return with_u.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _may_link(pairs: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes and parity sketches allow a link; met: (node, size, parity)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for k in (4, 5))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            fit = (apart * (100 + percent) <= (100 - percent) * (m + n)) & (np.minimum(m, n) * 100 >= percent * np.maximum(m, n))
            yield batch.select([0, 1]).filter(pa.array(fit))

    both = pairs.join(met.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("parity").alias("a")), "u").join(met.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("parity").alias("b")), "v")
    return both.select("u", "v", "m", "n", "a", "b").mapInArrow(check, "u long, v long")


def _sets_of(pairs: DataFrame, rows: DataFrame, words: int, known: DataFrame | None) -> DataFrame:
    """(node, shingles) of both sides of pairs at least, from rows (row, text) and what is known already."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h.tobytes() for h in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = cut(asked if known is None else asked.join(known, "node", "left_anti"))
    if known is not None and asked.isEmpty():
        return known
    made = cut(rows.join(asked.withColumnRenamed("node", "row"), "row", "left_semi").select("row", "text").mapInArrow(hashed, "node long, shingles binary"))
    return made if known is None else known.union(made)


def _links(rows: DataFrame, members: DataFrame, *, words: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes, enough to connect each component. rows: (row, text); members: (node, size, prefix, parity, whole)."""
    long, members = members.where("whole IS NOT NULL").select("node", "size", "whole"), members.withColumn("alone", F.when(F.col("whole").isNotNull(), F.col("node")))
    groups = cut(members.groupBy("size", "prefix", "alone").agg(F.min("node").alias("grp"), F.count("*").alias("many")))
    grouped = members.join(groups.select("grp", "many", F.col("size").alias("s"), F.col("prefix").alias("p"), F.col("alone").alias("a")), F.expr("size = s AND prefix = p AND alone <=> a"))
    members = grouped.select("node", "grp", "size", "parity", "many")
    lists = cut(_lists(groups, long, percent))
    shared = cut(lists.groupBy("key").agg(F.count("*").alias("total")).where("total > 1"))
    lists = cut(joined_by_hot_keys(lists, shared, "key", "total").select("key", "grp", "size"))
    # Only members of a listed group or of one with several can link.
    met = cut(members.join(lists.select("grp").distinct().withColumn("listed", F.lit(True)), "grp", "left").where("listed OR many > 1").select("node", "grp", "size", "parity"))
    own = met.where("node != grp").select(F.col("node").alias("u"), F.col("grp").alias("v"))
    pairs = cut(_may_link(_once(_first_of_lists(lists, percent).union(own)), met, percent))
    sets = _sets_of(pairs, rows, words, None)
    links = cut(_verified(pairs, sets, percent))
    for best in (True, False):
        # A few numbers a node, written once: what follows reads them several times, and plans stay small.
        parted = cut(met.select("node", "grp", "size").join(component_roots(links), "node", "left").select("grp", "node", "size", F.coalesce("root", "node").alias("part")))
        # A group of several is a list of its own too: its members share all of the prefix.
        listed = lists.select("key", "grp").join(parted, "grp").select("key", "node", "size", "part")
        listed = listed.unionByName(parted.select(F.xxhash64("grp", F.lit("group")).alias("key"), "node", "size", "part"))
        by_part = listed.groupBy("key", "part").agg(F.count("*").alias("many"))
        mixed = by_part.groupBy("key").agg(F.sum("many").alias("total"), F.max(F.struct("many", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        mixed = cut(mixed.select("key", "total", F.col("top.part").alias("main"), F.col("top.many").alias("most")))
        cells = _cells(listed, mixed).join(met.select("node", "parity"), "node")
        pairs = cut(_once(_candidates(cells, percent, best=best)))
        if pairs.isEmpty():
            break
        sets = _sets_of(pairs, rows, words, sets)
        links = cut(links.union(_verified(pairs, sets, percent)))
    return links


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs.

    A document's set is its distinct runs of `words` words (A-Z in lower case,
    split at ASCII white space); with fewer words, all of them as one. Documents
    link when the intersection of their sets is at least `percent` in a hundred
    of the union. component_id is the smallest doc_id that links reach, itself
    included, null where none of them has an id. Null texts and texts without
    words have an empty set and link with nothing, so each is its own component.
    Repeated rows link as equal sets and give repeated results, an empty table
    none; other columns are left out. docs should be a scan or a checkpoint, so
    that its rows come in the same order when read twice.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    everything = cut(_prints(rows, words))
    prints = everything.where(F.col("row").isNotNull()).drop("often")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    nodes = cut(prints.where("digest IS NOT NULL").groupBy("digest").agg(F.min(first).alias("first"), F.max("size").alias("size"), F.count("*").alias("copies")).withColumn("node", F.col("first.row")))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_shingles(everything, HOT))
    members = _prefixes(rows, words, percent, hot).join(nodes.select(F.col("node").alias("row"), "size"), "row").withColumnRenamed("row", "node")
    links = _links(rows.select("row", "text"), cut(members), words=words, percent=percent)
    # Each step is cut: the rows of the last one are used three times, and one plan of all of them runs so many stages at once that the driver's heap grows with them.
    joined = cut(nodes.join(component_roots(links), "node", "left").select("digest", "first", "copies", F.coalesce("root", "node").alias("root")))
    least = joined.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    named = cut(joined.join(least, "root").select("digest", "component_id", "copies"))
    wordless = prints.where("digest IS NULL").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    found = joined_by_hot_keys(prints.where("digest IS NOT NULL").select("doc_id", "size", "digest"), named, "digest", "copies").select("doc_id", "size", "component_id")
    return found.union(wordless).withColumnRenamed("size", "n_shingles")


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
