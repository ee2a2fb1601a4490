"""Connected components of a link table by large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SALTS = 16
#: Links that one partition of a round holds on average, at least. Rounds work on few links; as many tasks as the session deals would write mostly empty files.
LINKS_AT_ONCE = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links each neighbour above u to the least of u's neighbours and u.

    A node may have a large part of all links, so they are dealt by the node
    and a salt from the neighbour, and the least is listed under every salt.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts).select(F.col("u"), F.least("u", "m").alias("m"), salts.alias("salt"))
    dealt = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS).cast("long")))
    return dealt.join(least, ["u", "salt"]).coalesce(parts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links u and its neighbours below u to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    down = edges.join(least, "u").coalesce(parts).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v) that isn't its component's least node itself. Nodes may be of any ordered type."""
    edges = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    if before[0]:
        for _ in range(most_rounds):
            # No round has more links than the one before.
            parts = -(-before[0] // LINKS_AT_ONCE)
            edges = cut(_small_star(_large_star(edges.coalesce(parts), parts).distinct().coalesce(parts), parts).coalesce(parts))
            now = _mark(edges)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
