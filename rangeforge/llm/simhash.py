"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints are one node, so a large group of equal documents is compared
once. Nodes meet in groups of a common key, and a group's fingerprints are
stored as bit planes: one machine word holds one bit of 64 pairs. Planes of
differences are added up in carry-save counters, and words in which every pair
has exceeded the radius are abandoned. Found pairs are reduced to a spanning
forest in the task, so no group emits all its pairs.

Two ways to bring nodes together: `masks` keeps every pair within the radius, as
at most `radius` blocks of bits differ and all others are equal; the more nodes,
the more blocks, so that groups stay small without a lost pair. `sketch` takes
pairs of minima of hashed shingles, for radii where masks would be too short,
and finds two texts of Jaccard similarity 0.8 with probability 0.9999.

A rule with a similarity takes pairs within the radius as candidates only: each
is checked by the Jaccard similarity of the two sets of shingles. Nodes are then
told apart by a digest of the set as well, so only equal sets are one node.
Candidates are checked in three rounds: first each node's nearest one, which
joins most of a group of near copies by one pair a node; then each node's best
one in another component of the first round; then every candidate between two
different components of both. A pair within a component needs no check, so no
link between components is lost. From the second round on candidates must pass a
parity sketch too: a bit for each of PARITY residues, 1 if an odd number of the
set's hashes fall there. Two sketches differ in no more bits than the sets in
shingles, so hardly a pair under the similarity is read for the check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_name, joined_by_hot_keys, small_batches, table
from .components import component_roots

SEED = 42
MINIMA = 8
#: Groups up to this size compare all pairs at once; larger ones compare linked items with unlinked ones only.
SMALL_GROUP = 512
ROWS_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 15
#: Of a large group, items that all others are measured against in the first round: half nearest to the group's majority bits, half spread over it.
PIVOTS = 128
#: Bits of the parity sketch, and deviations that are allowed above the expected difference of large sets: one pair in 300,000 is left out.
PARITY, DEVIATIONS = 1024, 4.5
#: Rows that a group of one mask key should have on average, at most.
GROUP_ROWS = 64
_MIX = np.random.default_rng(2024).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class NearRule:
    """words: a shingle's length; bits: the fingerprint's; radius: differing bits that still link; keys: masks or sketch.

    similarity: if not 0, the Jaccard similarity of sets of shingles that a link needs. Fingerprints are of the set then, each shingle once; without, repeats count.
    """

    words: int = 4
    bits: int = 64
    radius: int = 4
    keys: str = "masks"
    similarity: float = 0.0

    def __post_init__(self):
        if self.bits % 64 or self.keys not in ("masks", "sketch") or (self.keys == "masks" and self.bits != 64):
            raise ValueError("bits must be a multiple of 64, and masks need 64 bits")


#: For a corpus stage: five words and a similarity of 0.8. Texts of Jaccard similarity 0.8 have a cosine of 0.89, so 78 of 512 bits
#: differ on average, with a deviation of 8: 112 leaves out one pair in 100,000.
CORPUS_RULE = NearRule(words=5, bits=512, radius=112, keys="sketch", similarity=0.8)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words; A-Z in lower case, words split at ASCII white space, joined by spaces."""
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(w), xxhash.xxh64_intdigest
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    if len(w) <= words:
        return np.array([hashed(joined, SEED)], np.uint64)
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from a 64-bit hash; the hash itself for 0."""
    if not k:
        return h
    x = (h + _MIX[k]) * _MIX[k - 1]
    x ^= x >> np.uint64(29)
    x *= _MIX[(k + 7) % 16]
    return x ^ (x >> np.uint64(32))


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """Big-endian; a bit is 1 if it is set in over half of the hashes."""
    total = np.zeros(bits, np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14)]
        planes = np.unpackbits(np.stack([_spread(part, k) for k in range(bits // 64)], axis=1).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for k in range(0, len(part), 255):
            total += planes[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").tobytes()[::-1]


def _sketch(h: np.ndarray) -> bytes:
    return np.array([_spread(h, k + 8).min() if len(h) else 0 for k in range(MINIMA)], np.uint64).tobytes()


def _parity(h: np.ndarray) -> bytes:
    places = _spread(h, 15) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, rule: NearRule, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with fp (big-endian bytes), sketch (empty but for sketch keys), parity, and kinds, the number of different shingles (empty and 0 without a similarity).

    Null texts count as empty: all bits zero. With a similarity, a digest of the set of shingles follows in fp.
    """
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0).to_pylist():
                h = shingle_hashes(text or "", rule.words)
                sketch = lambda: _sketch(h) if rule.keys == "sketch" else b""  # noqa: B023, E731
                if rule.similarity:
                    h = np.unique(h)
                    rows.append((fingerprint(h, rule.bits) + hashlib.blake2b(h.tobytes(), digest_size=16).digest(), sketch(), _parity(h), len(h)))
                else:
                    rows.append((fingerprint(h, rule.bits), sketch(), b"", 0))
            columns = [pa.array([r[k] for r in rows], pa.binary() if k < 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, "fp", "sketch", "parity", "kinds"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select("text", *keep).mapInArrow(measure, f"{kept}fp binary, sketch binary, parity binary, kinds long")


def mask_blocks(nodes: int, radius: int) -> int:
    """Blocks that 64 bits are cut into: enough that the others, when `radius` of them differ, tell GROUP_ROWS nodes or fewer alike on average."""
    return next((b for b in range(radius + 2, 2 * radius + 6) if nodes <= GROUP_ROWS << (64 * (b - radius) // b)), 2 * radius + 5)


def _mask_keys(fp: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """A key for each choice of the blocks that are equal, all but `radius` of them."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
    with np.errstate(over="ignore"):
        return np.stack([(fp[:, 0] & np.uint64(sum(equal))) * _MIX[0] + _MIX[1] * np.uint64(i + 1) for i, equal in enumerate(combinations(masks, blocks - radius))], axis=1)


def _sketch_keys(sketch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack([(sketch[:, a] * _MIX[0] ^ (sketch[:, b] >> np.uint64(7)) * _MIX[1]) + np.uint64(i) * _MIX[2] for i, (a, b) in enumerate(combinations(range(MINIMA), 2))], axis=1)


def _keyed(nodes: DataFrame, rule: NearRule, blocks: int, parity: bool = False) -> DataFrame:
    """(key, node, kinds, part, fp) of nodes (node, kinds, part, fp, sketch, parity), for each key of a node; fp without the digest, and followed by the parity sketch if told."""
    width = rule.bits // 8

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps = [x[:width] for x in batch.column(3).to_pylist()]
            sent = [x + y for x, y in zip(fps, batch.column(5).to_pylist(), strict=True)] if parity else fps
            if rule.keys == "masks":
                keys = _mask_keys(np.frombuffer(b"".join(fps), np.uint64).reshape(n, -1), rule.radius, blocks)
            else:
                keys = _sketch_keys(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(n, -1))
            times = pa.array(np.repeat(np.arange(n), keys.shape[1]))
            columns = [batch.column(k).take(times) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *columns, pa.array(sent, pa.binary()).take(times)], names=["key", "node", "kinds", "part", "fp"])

    return nodes.select("node", "kinds", "part", "fp", "sketch", "parity").mapInArrow(make, "key long, node long, kinds long, part long, fp binary")


class Planes:
    """Bit planes of fingerprints: word w of plane b holds bit b of items 64w to 64w + 63."""

    def __init__(self, fp: np.ndarray):
        n, width = fp.shape
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.bits, self.count = bits, n
        words = np.zeros((64 * width, -(-n // 64) * 8), np.uint8)
        words[:, : packed.shape[1]] = packed
        self.words = words.view(np.uint64)

    def shifted(self, d: int) -> np.ndarray:
        """Planes in which item i holds what item i + d holds."""
        whole, part = divmod(d, 64)
        out = np.zeros_like(self.words)
        end = self.words.shape[1] - whole
        out[:, :end] = self.words[:, whole:]
        if part:
            out >>= np.uint64(part)
            out[:, : end - 1] |= self.words[:, whole + 1 :] << np.uint64(64 - part)
        return out


def _within(differ, words: int, planes: int, radius: int, alive: np.ndarray, step: int = 16) -> np.ndarray:
    """Word mask of the pairs with at most radius differing bits. differ(lo, hi, columns): planes of differences of those words.

    Carry-save counters: level k holds words of weight 2^k, three of which
    become one and a carry. A word is abandoned once all of its pairs that
    count (alive) have exceeded the radius.
    """
    levels, columns = radius.bit_length(), np.flatnonzero(alive)
    counters = [np.zeros(len(columns), np.uint64) for _ in range(levels)]
    over, out = np.zeros(len(columns), np.uint64), np.zeros(words, np.uint64)
    for lo in range(0, planes, step):
        if not len(columns):
            break
        stacks = [[c] for c in counters] + [[]]
        stacks[0] += list(differ(lo, min(planes, lo + step), columns))
        for k in range(levels):
            stack = stacks[k]
            while len(stack) > 2:
                x, y, z = stack.pop(), stack.pop(), stack.pop()
                t = x ^ y
                stack.insert(0, t ^ z)
                stacks[k + 1].append((x & y) | (t & z))
            if len(stack) == 2:
                x, y = stack
                stack[:] = [x ^ y]
                stacks[k + 1].append(x & y)
            counters[k] = stack[0]
        for carry in stacks[levels]:
            over = over | carry
        more, equal = over.copy(), np.full(len(columns), ~np.uint64(0))
        for k in range(levels - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & counters[k]
            else:
                more |= equal & counters[k]
                equal = equal & ~counters[k]
        open_pairs = ~more & alive[columns]
        if lo + step >= planes:
            out[columns] = open_pairs
        else:
            keep = open_pairs != 0
            if not keep.all():
                columns, over, counters = columns[keep], over[keep], [c[keep] for c in counters]
    return out


def _bits_at(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def _pack(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    out = np.zeros(-(-len(flags) // 64) * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group within the radius; group is sorted. All pairs at distance d in the table are compared at once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.unique(group, return_counts=True)
    size = size[1][np.searchsorted(size[0], group)]
    rows, planes, d = np.arange(len(fp)), None, 1
    while len(live := rows[size[rows] > d]):
        if planes is None or 2 * len(live) <= planes.count:
            rows, planes = live, Planes(fp[live])
        g = group[rows]
        flags = np.zeros(len(rows), bool)
        flags[:-d] = g[d:] == g[:-d]
        other = planes.shifted(d)
        hit = _within(lambda lo, hi, c: planes.words[lo:hi][:, c] ^ other[lo:hi][:, c], planes.words.shape[1], len(planes.words), radius, _pack(flags))
        at = _bits_at(hit, len(rows))
        if len(at):
            found.append((rows[at], rows[at + d]))
        d += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _link_large(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the components of one large group. What a pivot reaches is one component; only items outside it are compared on."""
    planes, links = Planes(fp), []
    n, words = len(fp), planes.words.shape[1]
    everyone = _pack(np.ones(n, bool))
    root = np.arange(n)

    def link(i: int) -> np.ndarray:
        """Items within reach of i, one of each other component linked to it."""
        hits = _near_one(planes, i, radius, everyone, words, n)
        there, first = np.unique(root[hits], return_index=True)
        for r, k in zip(there.tolist(), first.tolist(), strict=True):
            if r != root[i]:
                links.append((i, int(hits[k])))
                root[root == r] = root[i]
        return hits

    asked = np.zeros(n, bool)
    covered = np.zeros(n, bool)
    for i in range(n):
        # An item within reach of an asked pivot is in its component. Its own links to items outside are found when those are asked.
        if not covered[i]:
            asked[i] = True
            covered[link(i)] = True
    # Covered items were never asked: two of them in different components may still be linked.
    if len(np.unique(root)) > 1:
        largest = np.bincount(root).argmax()
        for i in np.flatnonzero((root != largest) & ~asked).tolist():
            link(i)
    return links


def _near_one(planes: Planes, i: int, radius: int, alive: np.ndarray, words: int, n: int) -> np.ndarray:
    """Items of one group within the radius of item i."""
    flip = np.where(planes.bits[i], ~np.uint64(0), np.uint64(0)).astype(np.uint64)
    return _bits_at(_within(lambda lo, hi, c: planes.words[lo:hi][:, c] ^ flip[lo:hi, None], words, len(planes.words), radius, alive), n)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    parent, links = list(range(n)), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


def _apart(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of pairs."""
    return np.concatenate([np.bitwise_count(fp[a[k : k + PAIRS_AT_ONCE]] ^ fp[b[k : k + PAIRS_AT_ONCE]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), PAIRS_AT_ONCE)] or [np.zeros(0, np.int64)])


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity at all."""
    return np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6


def _may_link(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether sets of m and n shingles with these parity sketches may have the similarity, differing bits by 4096 shingles)."""
    d = np.concatenate([np.bitwise_count(x[k : k + PAIRS_AT_ONCE] ^ y[k : k + PAIRS_AT_ONCE]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), PAIRS_AT_ONCE)] or [np.zeros(0, np.int64)])
    most = (1 - similarity) / (1 + similarity) * (m + n)
    odd = (1 - np.exp(-2 * most / PARITY)) / 2
    return d <= np.minimum(most + 1e-6, PARITY * odd + DEVIATIONS * np.sqrt(PARITY * odd * (1 - odd))), d * 4096 // (m + n)


def _closest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, its partner at the least d, that d) of the items of pairs."""
    one, other, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    order = np.lexsort((other, d, one))
    one, other, d = one[order], other[order], d[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    return one[first], other[first], d[first]


def _nearest_small(fp: np.ndarray, group: np.ndarray, kinds: np.ndarray, rule: NearRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, its nearest candidate, differing bits) of every item that has candidates in its group."""
    a, b = near_pairs(fp, group, rule.radius)
    fit = _alike(kinds[a], kinds[b], rule.similarity)
    a, b = a[fit], b[fit]
    return _closest(a, b, _apart(fp, a, b))


def _nearest_large(fp: np.ndarray, kinds: np.ndarray, rule: NearRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _nearest_small for one large group, but an item near a pivot takes the nearest pivot; only one with none in reach is compared with all."""
    n = len(fp)
    ones = sum(np.unpackbits(fp[k : k + PAIRS_AT_ONCE].view(np.uint8), axis=1).reshape(-1, fp.shape[1] * 64).sum(axis=0, dtype=np.int64) for k in range(0, n, PAIRS_AT_ONCE))
    middle = np.packbits(2 * ones > n).view(np.uint64)
    central = np.argsort(np.bitwise_count(fp ^ middle).sum(axis=1, dtype=np.int64), kind="stable")[: PIVOTS // 2]
    best, least = np.arange(n), np.full(n, rule.radius + 1)
    for p in np.unique(np.concatenate([central, np.linspace(0, n - 1, PIVOTS // 2).astype(int)])).tolist():
        d = np.bitwise_count(fp ^ fp[p]).sum(axis=1, dtype=np.int64)
        d[~_alike(kinds, kinds[p], rule.similarity)] = rule.radius + 1
        d[p] = rule.radius + 1
        nearer = d < least
        best[nearer], least[nearer] = p, d[nearer]
    rest = np.flatnonzero(least > rule.radius)
    if len(rest):
        planes, everyone = Planes(fp), _pack(np.ones(n, bool))
        for i in rest.tolist():
            hits = _near_one(planes, i, rule.radius, everyone, planes.words.shape[1], n)
            hits = hits[(hits != i) & _alike(kinds[hits], kinds[i], rule.similarity)]
            if len(hits):
                d = _apart(fp, np.full(len(hits), i), hits)
                best[i], least[i] = hits[d.argmin()], d.min()
    found = np.flatnonzero(least <= rule.radius)
    return found, best[found], least[found]


def _across_small(fp: np.ndarray, group: np.ndarray, kinds: np.ndarray, part: np.ndarray, rule: NearRule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, how far apart) of every candidate between two parts of a group. fp is followed by the parity sketch."""
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
    rows = np.flatnonzero(np.repeat(mixed, np.diff(np.append(starts, len(group)))))
    if len(rows):
        width = rule.bits // 64
        a, b = near_pairs(fp[rows, :width], group[rows], rule.radius)
        a, b = rows[a], rows[b]
        fit = (part[a] != part[b]) & _alike(kinds[a], kinds[b], rule.similarity)
        a, b = a[fit], b[fit]
        fit, d = _may_link(fp[a, width:], fp[b, width:], kinds[a], kinds[b], rule.similarity)
        yield a[fit], b[fit], d[fit]


def _across_large(fp: np.ndarray, kinds: np.ndarray, part: np.ndarray, rule: NearRule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _across_small, for one large group. Pairs with the largest part are found from their other side."""
    _, part = np.unique(part, return_inverse=True)
    largest, n, width = np.bincount(part).argmax(), len(fp), rule.bits // 64
    outside = np.flatnonzero(part != largest)
    if not len(outside):
        return
    planes, everyone = Planes(fp[:, :width]), _pack(np.ones(n, bool))
    for i in outside.tolist():
        hits = _near_one(planes, i, rule.radius, everyone, planes.words.shape[1], n)
        hits = hits[(part[hits] != part[i]) & ((hits > i) | (part[hits] == largest)) & _alike(kinds[hits], kinds[i], rule.similarity)]
        if len(hits):
            fit, d = _may_link(fp[hits, width:], fp[i : i + 1, width:], kinds[hits], kinds[i], rule.similarity)
            yield np.full(fit.sum(), i), hits[fit], d[fit]


def _best_of(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs among n items, each item's closest one; held are two numbers an item, whatever the number of pairs."""
    partner, least = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    for a, b, d in pairs:
        for item, other, far in zip(*_closest(a, b, d), strict=True):
            if far < least[item]:
                partner[item], least[item] = other, far
    found = np.flatnonzero(partner >= 0)
    yield found, partner[found], least[found]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(starts, sizes, node, kinds, part, fp) of whole groups of rows in the order of their key, about ROWS_AT_ONCE rows together."""

    def cut_at(n: int | None) -> tuple[np.ndarray, ...]:
        key, *more = (c[:n] for c in whole)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return starts, np.diff(np.append(starts, len(key))), *more

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([*(batch.column(k).to_numpy() for k in range(4)), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)])
        rows += batch.num_rows
        last = held[-1][0][-1]
        if rows >= ROWS_AT_ONCE and held[0][0][0] != last:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(whole[0], last))  # the last group may go on
            yield cut_at(end)
            held, rows = [[c[end:] for c in whole]], rows - end
    if held:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield cut_at(None)


def _grouped(keyed: DataFrame, large, small, schema: str) -> DataFrame:
    """Runs `large` on each large group and `small` on all others of a batch together; both give tuples of columns, rows by their place among those given."""
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, sizes, node, *columns in _whole_groups(batches):
            def found(rows: np.ndarray, parts: Iterator[tuple[np.ndarray, ...]], node=node) -> Iterator[pa.RecordBatch]:
                for u, v, *more in parts:
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(node[rows[u]]), pa.array(node[rows[v]]), *map(pa.array, more)], names=names)

            for lo, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
                rows = np.arange(lo, lo + n)
                yield from found(rows, large(*(c[lo : lo + n] for c in columns)))
            group = np.repeat(np.arange(len(starts)), sizes)
            rows = np.flatnonzero(((sizes > 1) & (sizes <= SMALL_GROUP))[group])
            if len(rows):
                yield from found(rows, small(group[rows], *(c[rows] for c in columns)))

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare, schema)


def _linked(keyed: DataFrame, rule: NearRule) -> DataFrame:
    """Links (u, v) within the radius: a spanning forest of each group."""

    def forest(links: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if links:
            yield tuple(np.array(links).T)

    large = lambda kinds, part, fp: forest(_link_large(fp, rule.radius))
    small = lambda group, kinds, part, fp: forest(_forest(*near_pairs(fp, group, rule.radius), len(fp)))
    return _grouped(keyed, large, small, "u long, v long").distinct()


def _closest_of_all(found: DataFrame) -> DataFrame:
    return found.groupBy("u").agg(F.min(F.struct("d", "v")).alias("best")).select("u", F.col("best.v").alias("v"))


def _nearest(keyed: DataFrame, rule: NearRule) -> DataFrame:
    """(u, v): the nearest candidate, over all its groups, of each node that has one. In a large group a pivot stands for the nearest."""
    large = lambda kinds, part, fp: iter([_nearest_large(fp, kinds, rule)])
    small = lambda group, kinds, part, fp: iter([_nearest_small(fp, group, kinds, rule)])
    return _closest_of_all(_grouped(keyed, large, small, "u long, v long, d long"))


def _across(keyed: DataFrame, rule: NearRule, *, best: bool) -> DataFrame:
    """Candidates (u, v) between nodes of different parts: all of them or, for each node, the best."""
    chosen = _best_of if best else lambda pairs, n: pairs
    large = lambda kinds, part, fp: chosen(_across_large(fp, kinds, part, rule), len(fp))
    small = lambda group, kinds, part, fp: chosen(_across_small(fp, group, kinds, part, rule), len(fp))
    found = _grouped(keyed, large, small, "u long, v long, d long")
    return _closest_of_all(found) if best else found


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs (u, v) whose sets of shingles have the rule's similarity. The set of v travels to u, that of u is read beside it."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both > 0 and both >= rule.similarity * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    with_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return with_v.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _similar_links(nodes: DataFrame, rule: NearRule, texts: DataFrame) -> DataFrame:
    """Links (u, v) of candidates with the rule's similarity, enough to connect each component. texts: (node, text) of all nodes at least."""
    nearest = cut(_nearest(_keyed(nodes.withColumn("part", F.lit(0).cast("long")), rule, 0), rule))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text or "", rule.words)).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    # No node without a nearest candidate is met again.
    met = nearest.select(F.col("u").alias("node"))
    sets = cut(texts.join(met, "node", "left_semi").select("node", "text").mapInArrow(hashed, "node long, shingles binary"))
    links = cut(_similar(_pairs(nearest), sets, rule))
    again = cut(nodes.join(met, "node", "left_semi"))
    for best in (True, False):
        parted = again.join(component_roots(links), "node", "left").withColumn("part", F.coalesce("root", "node"))
        more = cut(_pairs(_across(_keyed(parted, rule, 0, parity=True), rule, best=best)))
        links = cut(links.union(_similar(more, sets, rule)))
    return links


def _nodes(prints: DataFrame) -> DataFrame:
    """One row (fp, node, first, sketch, parity, kinds, copies) for each fingerprint of prints (doc_id, row, fp, sketch, parity, kinds).

    first is struct(no_id, doc_id, row), the least of its rows; node is its row.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("first")
    return cut(prints.groupBy("fp").agg(first, F.min("sketch").alias("sketch"), F.min("parity").alias("parity"), F.min("kinds").alias("kinds"), F.count("*").alias("copies")).withColumn("node", F.col("first.row")))


def _roots(nodes: DataFrame, rule: NearRule, texts: DataFrame | None) -> DataFrame:
    """(first, root) of every node that isn't the least of its component; root is the component's least `first`."""
    if rule.similarity:
        links = _similar_links(nodes, rule, texts)
    else:
        blocks = mask_blocks(nodes.count(), rule.radius) if rule.keys == "masks" else 0
        links = _linked(_keyed(nodes.withColumn("part", F.lit(0).cast("long")), rule, blocks), rule)
    named = nodes.select("node", "first")
    ends = links.join(named.toDF("u", "a"), "u").join(named.toDF("v", "b"), "v")
    return component_roots(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("first"), "root")


def near_components(docs: DataFrame, rule: NearRule = NearRule()) -> DataFrame:
    """One row (doc_id, fp, component_id) for each row of docs; fp is big-endian.

    component_id is the smallest doc_id that links reach, itself included; null
    where no document of the component has an id. Null texts count as empty,
    and all texts without a word share the zero fingerprint, which links like
    any other. Repeated rows give repeated results; other columns are left out.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    prints = cut(fingerprints(numbered, rule, ["doc_id", "row"]))
    nodes = _nodes(prints)
    texts = numbered.select(F.col("row").alias("node"), "text") if rule.similarity else None
    named = nodes.join(_roots(nodes, rule, texts), "first", "left").select("fp", F.coalesce("root", "first")["doc_id"].alias("component_id"), "copies")
    rows = joined_by_hot_keys(prints.select("doc_id", "fp"), named, "fp", "copies")
    return rows.select("doc_id", F.substring("fp", 1, rule.bits // 8).alias("fp"), "component_id")


def drop_near_copies(docs: DataFrame, rule: NearRule = CORPUS_RULE) -> DataFrame:
    """Rows of docs, columns as they are, one of each component: that with the smallest doc_id, null ids last.

    Texts without a word are no copies of one another here and all stay; so do
    all rows of an empty table. docs should be a scan or a checkpoint, so that
    its rows come in the same order when read twice.
    """
    row = fresh_name(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    speaks = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    spoken = numbered.where(speaks).select("doc_id", "text", F.col(row).alias("row"))
    nodes = _nodes(fingerprints(spoken, rule, ["doc_id", "row"]))
    stay = nodes.join(_roots(nodes, rule, spoken.select(F.col("row").alias("node"), "text")), "first", "left_anti")
    silent = numbered.where(~speaks).select(docs.columns)
    return numbered.join(stay.select(F.col("node").alias(row)), row, "left_semi").select(docs.columns).union(silent)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
