"""Exact dedup by skew-safe combining (DataFrame functions only).

Three combines, each keyed by the digest and the full normalised text, so that
texts are compared whole at every stage: within each task before anything is
shuffled, then within (digest, salt) groups, then over the salt winners. A group
of copies that holds a third of all rows reaches the second stage as one row a
task and the third as one row a salt.

Rows find their group by the digest: where a digest stands for one text only,
that is as good as the text. Digests of over one row in a thousand are
broadcast, fewer than a thousand in all, and their rows stay where they are.
Where a digest stands for several texts, rows are joined by the text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, fresh_name, joined_by_hot_keys, table, text_or_empty

SALTS = 8


def _sha(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(), SPACE, " ")
    return docs.select("doc_id", F.monotonically_increasing_id().alias("__rf_row"), norm.alias("__rf_norm")).withColumn("__rf_digest", digest(F.col("__rf_norm")))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, first, size) a group; first is struct(no_id, doc_id, row), the least of the group."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("__rf_row").alias("row"))
    dealt = rows.withColumn("__rf_salt", F.pmod("__rf_row", F.lit(salts)).cast("int"))
    salted = dealt.groupBy("__rf_digest", "__rf_salt", "__rf_norm").agg(F.min(first).alias("first"), F.count("*").alias("size"))
    return salted.groupBy("__rf_digest", "__rf_norm").agg(F.min("first").alias("first"), F.sum("size").alias("size"))


def exact_groups(docs: DataFrame, *, salts: int = SALTS, digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when identical after each run of ASCII white space is one
    space; null counts as empty. The smallest doc_id stays, null ids last; of
    repeated rows with that id exactly one is kept. An empty table gives no rows;
    columns other than doc_id and text are left out, whatever their names. Any
    digest gives the same groups, as texts of equal digests are told apart by
    themselves. docs should be a scan or a checkpoint, so that its rows come in
    the same order when read again.
    """
    rows = _keyed(docs, digest)
    by_digest = _winners(rows, salts).groupBy("__rf_digest").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.count("*").alias("texts"))
    named = cut(by_digest)
    joined = joined_by_hot_keys(rows.select("doc_id", "__rf_row", "__rf_digest"), named.where("texts = 1").drop("texts"), "__rf_digest", "size")
    if not named.where("texts > 1").isEmpty():
        mixed = rows.join(named.where("texts > 1").select("__rf_digest"), "__rf_digest", "left_semi")
        joined = joined.unionByName(mixed.join(_winners(mixed, salts), ["__rf_digest", "__rf_norm"]).select(joined.columns))
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("first.row") == F.col("__rf_row")).alias("kept"), F.col("__rf_digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """Rows of docs, columns as they are, one of each group of equal texts (see exact_groups)."""
    row = fresh_name(docs, "__rf_row")
    kept = _winners(_keyed(docs, _sha), salts).select(F.col("first.row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
