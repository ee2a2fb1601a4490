"""Exact percentiles of groups of any size, by counting between splitters.

An order statistic lies in a bracket of values. A pass counts a bracket's rows
between splitters, which are a sample of its own quantiles of bounded size, and
apart those equal to a splitter; the part that holds the rank is the next
bracket. A pass leaves about one row in SPLITTERS, so 10^12 rows take five, each
over the rows of the bracket only; what is left at last, BUCKET rows of a
bracket at most, is counted by value. No buffer grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import settled
from .matching import dimension

SPLITTERS = 256
BUCKET = 10_000


def _in_brackets(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, value) of the rows within each bracket; brackets are few."""
    few = dimension(brackets.select(*[F.col(k).alias(f"__{k}") for k in keys], "lo", "hi"))
    same = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(few, same).select(*keys, "lo", "hi", "value")


def order_statistics(rows: DataFrame, keys: list[str], ranks: DataFrame, *, splitters: int = SPLITTERS, bucket: int = BUCKET) -> DataFrame:
    """(keys, rank, at): the value of each rank, from 0 in ascending order, among rows (keys, value).

    ranks has (keys, rank, lo, hi, inside): the least and greatest value of the
    group and its rows; values are doubles without nulls.
    """
    by = [*keys, "lo", "hi"]
    state = settled(ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"))
    while True:
        wide = state.where((F.col("inside") > bucket) & (F.col("lo") < F.col("hi")))
        brackets = wide.select(*by).distinct()
        if wide.isEmpty():
            break
        held = _in_brackets(rows, brackets, keys)
        cuts = settled(held.groupBy(*by).agg(F.percentile_approx("value", [i / splitters for i in range(1, splitters)], F.lit(8 * splitters)).alias("cuts")).withColumn("cuts", F.array_distinct("cuts")))
        known = dimension(cuts.select(*[F.col(k).alias(f"_{k}") for k in by], "cuts"))
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        # An odd place is a splitter's own, an even one lies between two; every part has fewer values than the bracket.
        place = F.expr("2 * size(filter(cuts, c -> c < value)) + int(array_contains(cuts, value))")
        parts = held.join(known, same).groupBy(*by, place.alias("place")).agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
        upto = parts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        right = upto.select(*[F.col(k).alias(f"_{k}") for k in by], "n", "first", "last", "upto")
        within = same & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("below") + F.col("upto"))
        closer = wide.join(right, within).select(*keys, "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("inside"))
        state = settled(closer.union(state.where((F.col("inside") <= bucket) | (F.col("lo") == F.col("hi")))))
    narrow = state.where("lo < hi")
    counts = _in_brackets(rows, narrow.select(*by).distinct(), keys).groupBy(*by, "value").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    right = upto.select(*[F.col(k).alias(f"_{k}") for k in by], "value", "upto")
    same = F.col("rank") < F.col("below") + F.col("upto")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = narrow.join(right, same).groupBy(*keys, "rank").agg(F.min("value").alias("at"))
    return found.union(state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("at")))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, at: list[float], **sizes) -> DataFrame:
    """(keys, n, q): for each group the rows whose value isn't null, and the percentiles `at`, linear between the two nearest rows. Groups without a value are left out; NaN counts as none."""
    held = rows.select(F.struct(*keys).alias("key"), F.col(value).cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    groups = settled(held.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    asked = groups.select("*", F.posexplode(F.array(*map(F.lit, map(float, at)))).alias("k", "p"))
    asked = asked.withColumn("place", F.col("p") * (F.col("n") - 1)).withColumns({"under": F.floor("place"), "over": F.ceil("place")})
    ranks = asked.select("key", F.explode(F.array("under", "over")).alias("rank"), "lo", "hi", F.col("n").alias("inside")).distinct()
    found = settled(order_statistics(held, ["key"], ranks, **sizes))
    for side in ("under", "over"):
        named = found.select(F.col("key").alias("_key"), F.col("rank").alias("_rank"), F.col("at").alias(f"at_{side}"))
        asked = asked.join(named, (F.col(side) == F.col("_rank")) & F.col("key").eqNullSafe(F.col("_key"))).drop("_rank", "_key")
    q = F.when(F.col("under") == F.col("over"), F.col("at_under")).otherwise((F.col("over") - F.col("place")) * F.col("at_under") + (F.col("place") - F.col("under")) * F.col("at_over"))
    return asked.withColumn("q", q).groupBy("key", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q")).select("key.*", "n", "q")
