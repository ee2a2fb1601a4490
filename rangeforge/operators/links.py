"""Connected components of links on DataFrames, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_folder


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; what led to them isn't computed again."""
    context = df.sparkSession.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(scratch_folder(df.sparkSession, "settled"))
    return df.checkpoint(eager=True)


def linked_roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of every node of links (keys, u, v): nodes that links connect have the same root, one of them.

    In each round every node follows its neighbour of least random rank, if that
    is less than its own, and the nodes that none is left for are contracted with
    those they follow. Ranks are drawn anew in each round, so a chain shortens by
    a part of its length and rounds grow with the logarithm of the links. A node
    of many links meets them in partial minima only.
    """
    steps: list[DataFrame] = []
    edges = settled(links.where("u != v").select(*keys, "u", "v").distinct())
    while not edges.isEmpty():
        rank = lambda c, n=len(steps): F.struct(F.xxhash64(F.lit(n), *keys, c), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy(*keys, "u").agg(F.min(rank("v")).alias("near"))
        follows = settled(nearest.select(*keys, F.col("u").alias("node"), F.least(F.col("near"), rank("u"))["node"].alias("to")))
        steps.append(follows)
        of = lambda c: follows.select(*keys, F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        moved = edges.join(of("u"), [*keys, "u"]).join(of("v"), [*keys, "v"]).where("to_u != to_v")
        edges = settled(moved.select(*keys, F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
    if not steps:
        return links.select(*keys, F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    roots = steps[0].withColumnRenamed("to", "root")
    for follows in steps[1:]:
        roots = roots.join(follows.withColumnRenamed("node", "root"), [*keys, "root"], "left").select(*keys, "node", F.coalesce("to", "root").alias("root"))
    return roots


def near_blocks(cell: Column, side: int) -> Column:
    """Numbers of the blocks, `side` cells wide, that hold the cell or a cell beside it: one or two along an axis."""
    return F.array_distinct(F.array(*[F.floor((cell + o) / side) for o in (-1, 0, 1)]))
