"""Connected components by frame, whose cells a sensor's grid bounds, and clusters of clouds of any size.

A cloud is cut into blocks of cells. A block also gets the points of the cells
around it, so each task finds all links of its own points and joins them there;
a point that lies in several blocks links what they found. Only those links, a
few for each part of a block's cluster, are contracted over the whole cloud.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .links import linked_roots, near_blocks

#: Cells along the side of a block.
SIDE = 8
#: Pairs of points whose distance is taken at once.
PAIRS_AT_ONCE = 1 << 18
CROSS = [(0, 1), (1, 0)]
SQUARE = [(0, 1), (1, 0), (1, 1), (1, -1)]
HALF_26 = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def join_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component of each of n items linked by pairs (a, b): the least item in it. Labels are halved along the links until they rest."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def neighbour_pairs(cells: np.ndarray, offsets: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of distinct integer cells that lie at one of the offsets."""
    low = cells.min(axis=0) - 1
    size = cells.max(axis=0) - low + 2
    weight = np.concatenate([np.cumprod(size[::-1])[::-1][1:], [1]])
    key = (cells - low) @ weight
    order = np.argsort(key)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for o in offsets:
        want = key + np.array(o) @ weight
        at = np.minimum(np.searchsorted(key[order], want), len(key) - 1)
        hit = key[order][at] == want
        found.append((np.flatnonzero(hit), order[at[hit]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def label_cells(cells: np.ndarray, connectivity: int) -> np.ndarray:
    return join_pairs(len(cells), *neighbour_pairs(cells, CROSS if connectivity == 4 else SQUARE))


def components(cells: DataFrame, keys: list[str], *, connectivity: int = 4, at_least: int = 1) -> DataFrame:
    """(keys, iu, iv, component, size): components of the set cells of each key, named by their least (iu, iv) in that order, of at least so many cells."""
    ship_package(cells.sparkSession)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iu", "iv"], ignore_index=True)
        root = label_cells(pdf[["iu", "iv"]].to_numpy(np.int64), connectivity)
        size = np.bincount(root, minlength=len(pdf))[root]
        return pdf.assign(component=[f"{u}:{v}" for u, v in pdf[["iu", "iv"]].to_numpy()[root]], size=size)[size >= at_least]

    kinds = ", ".join(f"{c} {dict(cells.dtypes)[c]}" for c in [*keys, "iu", "iv"])
    return cells.select(*keys, "iu", "iv").distinct().groupBy(*keys).applyInPandas(label, f"{kinds}, component string, size long")


def top_components(labelled: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, clusters): the k largest components as array<struct<size, u, v>> of their mean place, by (size, u, v) descending."""
    each = labelled.groupBy(*keys, "component").agg(F.count("*").alias("size"), F.avg("iu").alias("u"), F.avg("iv").alias("v"))
    ordered = F.reverse(F.sort_array(F.collect_list(F.struct("size", "u", "v"))))
    return each.groupBy(*keys).agg(F.slice(ordered, 1, k).alias("clusters"))


def _near_pairs(xyz: np.ndarray, i: np.ndarray, j: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points i and j within eps, in pieces that look at PAIRS_AT_ONCE pairs at most."""
    wide = min(len(j), 1 << 12)
    for lo in range(0, len(i), PAIRS_AT_ONCE // wide):
        for at in range(0, len(j), wide):
            p, q = i[lo : lo + PAIRS_AT_ONCE // wide], j[at : at + wide]
            x, y = np.nonzero(((xyz[p, None] - xyz[None, q]) ** 2).sum(axis=2) <= eps * eps)
            if len(x):
                yield p[x], q[y]


def _grouped(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells, rows in the order of their cells, and where each cell's rows start, with an end."""
    cells, where = np.unique(cell, axis=0, return_inverse=True)
    where = where.ravel()
    return cells, np.argsort(where, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(cells)))])


def eps_labels(xyz: np.ndarray, eps: float, *, compat: bool = False) -> np.ndarray:
    """Clusters of points linked at a distance of at most eps.

    Points of a cell whose diagonal is under eps are linked, so only cells are
    joined: first by their outermost points towards one another, then, where
    that joined no two, by their points near the other's. Memory is in
    proportion to the points, however many of them are near one another.
    compat leaves out what an incomplete neighbour list leaves out, see
    compat_labels.
    """
    if compat:
        return compat_labels(xyz, eps)
    dims = xyz.shape[1]
    width = eps / math.sqrt(dims) * (1 - 1e-9)
    cells, members, start = _grouped(np.floor(xyz / width).astype(np.int64))
    at, many = xyz[members], np.diff(start)
    of = np.repeat(np.arange(len(cells)), many)
    lows, highs = np.minimum.reduceat(at, start[:-1]), np.maximum.reduceat(at, start[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_a, open_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def outermost(along: np.ndarray) -> np.ndarray:
        """Row of each cell's greatest value."""
        hit = np.flatnonzero(along == np.maximum.reduceat(along, start[:-1])[of])
        return hit[np.searchsorted(of[hit], np.arange(len(cells)))]

    reach = math.isqrt(dims) + 1
    for o in itertools.product(range(-reach, reach + 1), repeat=dims):
        if o <= (0,) * dims or sum(max(0, abs(k) - 1) ** 2 for k in o) > dims:
            continue
        a, b = neighbour_pairs(cells, [o])
        gap = np.maximum(0, np.maximum(lows[b] - highs[a], lows[a] - highs[b]))
        able = (gap**2).sum(axis=1) <= eps * eps * (1 + 1e-9)
        a, b = a[able], b[able]
        if not len(a):
            continue
        along = at @ np.array(o, float)
        p, q = outermost(along)[a], outermost(-along)[b]
        near = ((at[p] - at[q]) ** 2).sum(axis=1) <= eps * eps
        found.append((a[near], b[near]))
        rest = ~near & (many[a] * many[b] > 1)
        open_a.append(a[rest])
        open_b.append(b[rest])
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*found, strict=True) if found else ((), ())))
    root = join_pairs(len(cells), a, b)
    a, b = np.concatenate(open_a), np.concatenate(open_b)
    apart = root[a] != root[b]
    follows = root.tolist()

    def top(k: int) -> int:
        while follows[k] != k:
            follows[k] = k = follows[follows[k]]
        return k

    def towards(k: int, other: int) -> np.ndarray:
        own = np.arange(start[k], start[k + 1])
        gap = np.maximum(0, np.maximum(lows[other] - at[own], at[own] - highs[other]))
        return own[(gap**2).sum(axis=1) <= eps * eps * (1 + 1e-9)]

    for k, n in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        x, y = sorted((top(k), top(n)))
        if x != y:
            i, j = towards(k, n), towards(n, k)
            if len(i) and len(j) and next(_near_pairs(at, i, j, eps), None) is not None:
                follows[y] = x
    tops = np.array([top(k) for k in range(len(cells))], np.int64)
    # A cluster is named by its first row.
    first = np.full(len(cells), len(xyz))
    np.minimum.at(first, tops[of], members)
    out = np.empty(len(xyz), np.int64)
    out[members] = first[tops[of]]
    return out


def compat_labels(xyz: np.ndarray, eps: float) -> np.ndarray:
    """Clusters without the links of pairs within one cell of eps and of pairs in the cells straight above or along one diagonal. Links are joined as they add up."""
    cells, members, start = _grouped(np.floor(xyz / eps).astype(np.int64))
    a, b = neighbour_pairs(cells, [o for o in HALF_26 if o not in ((0, 0, 1), (1, 1, -1))])
    label, left, right, held = np.arange(len(xyz)), [], [], 0

    def joined() -> np.ndarray:
        return join_pairs(len(xyz), np.concatenate([np.arange(len(xyz)), *left]), np.concatenate([label, *right]))

    for p, q in zip(a, b, strict=True):
        for i, j in _near_pairs(xyz, members[start[p] : start[p + 1]], members[start[q] : start[q + 1]], eps):
            left.append(i)
            right.append(j)
            held += len(i)
            if held > max(len(xyz), 1 << 20):
                label, left, right, held = joined(), [], [], 0
    return joined()


def _in_blocks(nodes: DataFrame, keys: list[str], xyz: list[str], width: float, label, side: int) -> DataFrame:
    """(keys, node, root) of nodes (keys, node, xyz): the nodes that label(coordinates) puts together in some block have one root."""
    ship_package(nodes.sparkSession)
    blocks = [f"__block{k}" for k in range(len(xyz))]
    placed = nodes.select(*keys, "node", *xyz)
    for b, c in zip(blocks, xyz, strict=True):
        placed = placed.withColumn(b, F.explode(near_blocks(F.floor(F.col(c) / width), side)))
    own = F.lit(True)
    for b, c in zip(blocks, xyz, strict=True):
        own = own & (F.col(b) == F.floor(F.floor(F.col(c) / width) / side))
    kinds = dict(nodes.dtypes)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        root = label(pdf[xyz].to_numpy(float))
        return pdf[[*keys, "node", "own"]].assign(piece=pdf["node"].to_numpy()[root])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    pieces = placed.withColumn("own", own).groupBy(*keys, *blocks).applyInPandas(joined, f"{schema}node {kinds['node']}, own boolean, piece {kinds['node']}")
    # A node lies in eight blocks at most, and in one for most.
    met = pieces.groupBy(*keys, "node").agg(F.min(F.when(F.col("own"), F.col("piece"))).alias("u"), F.collect_set("piece").alias("pieces"))
    links = met.select(*keys, "u", F.explode("pieces").alias("v")).where("u != v")
    roots = linked_roots(links, keys).withColumnRenamed("node", "u")
    return met.select(*keys, "node", "u").join(roots, [*keys, "u"], "left").select(*keys, "node", F.coalesce("root", "u").alias("root"))


def eps_clusters(points: DataFrame, keys: list[str], xyz: list[str], order: str, eps: float, *, min_pts: int = 3, compat: bool = False, side: int = SIDE) -> DataFrame:
    """(keys, order, cluster, size): points of clusters of at least min_pts; a cluster is named by its least `order`.

    Points of one place are one node, however many they are; with compat, which
    leaves out links within a cell, each is its own. Points with a null in a
    coordinate or in `order` are in no cluster. A task holds a block of `side`
    cells of eps along each axis with the cells around it.
    """
    known = points.select(*keys, order, *xyz).dropna(subset=[order, *xyz])
    place = [*keys, *xyz, order] if compat else [*keys, *xyz]
    nodes = known.groupBy(*place).agg(F.min(order).alias("node"), F.count("*").alias("many"))
    roots = _in_blocks(nodes, keys, xyz, eps, lambda at: eps_labels(at, eps, compat=compat), side)
    found = nodes.join(roots, [*keys, "node"])
    clusters = found.groupBy(*keys, "root").agg(F.min("node").alias("cluster"), F.sum("many").alias("size")).where(F.col("size") >= min_pts)
    return known.join(found.join(clusters, [*keys, "root"]).select(*place, "cluster", "size"), place).select(*keys, order, "cluster", "size")


def cell_clusters(points: DataFrame, keys: list[str], xyz: list[str], order: str, size: float, *, side: int = SIDE) -> DataFrame:
    """(keys, order, cluster): points whose cells touch, corners included, without a distance test; named by the least `order`.

    A cell is one node, however many points it has. Points with a null in a
    coordinate or in `order` are in no cluster.
    """
    cells = [f"__cell{k}" for k in range(len(xyz))]
    known = points.select(*keys, order, *xyz).dropna(subset=[order, *xyz]).select(*keys, order, *[F.floor(F.col(c) / size).alias(n) for c, n in zip(xyz, cells, strict=True)])
    nodes = known.groupBy(*keys, *cells).agg(F.min(order).alias("node"))

    def touching(at: np.ndarray) -> np.ndarray:
        return join_pairs(len(at), *neighbour_pairs(at.astype(np.int64), HALF_26))

    found = nodes.join(_in_blocks(nodes, keys, cells, 1.0, touching, side), [*keys, "node"])
    clusters = found.groupBy(*keys, "root").agg(F.min("node").alias("cluster"))
    return known.join(found.join(clusters, [*keys, "root"]).select(*keys, *cells, "cluster"), [*keys, *cells]).select(*keys, order, "cluster")


def cluster_report(points: DataFrame, keys: list[str], xyz: list[str], intensity: str) -> DataFrame:
    """Count, centre, spans and mean intensity of each cluster."""
    parts = [F.count("*").alias("n")]
    for c in xyz:
        parts += [F.avg(c).alias(f"c_{c}"), (F.max(c) - F.min(c)).alias(f"span_{c}")]
    return points.groupBy(*keys, "cluster").agg(*parts, F.avg(intensity).alias("i_mean"))


