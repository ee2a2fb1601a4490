"""URL filters by a sorted range sweep over reversed-host keys (DataFrame functions only).

A host turns into a key of its labels in reverse, each closed by NUL, so that a
rule's host covers exactly the keys of one interval: from its own key up to the
same key with its last byte one higher. Rule intervals are either nested or
disjoint. One sort puts interval bounds and urls in key order; the running last
bound before a url carries the stack of rules that are open there, and the
longest whose path fits decides.

Urls are dealt over lanes at random, and each lane gets all bounds, so a host
that holds a third of all pages spreads over every lane. The bounds are copied
once a lane: rules x lanes rows, without any broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table

NUL, END = "\u0000", "\u0001"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def url_parts(url: Column) -> Column:
    """struct(host, path) of a url; both empty for null or without '://'."""
    rest = F.expr("CASE WHEN instr(__rf_url, '://') > 0 THEN substring(__rf_url, instr(__rf_url, '://') + 3) END")
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.struct(host.alias("host"), path.alias("path"))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by NUL; bytes that mark bounds are taken out of labels, and the final test compares real hosts."""
    labels = F.reverse(F.split(F.translate(host, NUL + END, ""), r"\."))
    return F.concat(F.array_join(labels, NUL), F.lit(NUL))


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules that are open from this key on. Both bounds of each rule host."""
    hosts = rules.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    hosts = hosts.withColumn("key", host_key(F.col("host")))
    above = (
        hosts.select(F.col("host").alias("inner_host"), F.col("key").alias("inner_key"))
        .withColumn("labels", F.split("inner_host", r"\."))
        .select("inner_host", "inner_key", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"), "labels")
        .withColumn("host", F.expr("array_join(slice(labels, k, size(labels)), '.')"))
        .join(hosts.select("host", "own"), "host")
    )
    stacks = above.groupBy("inner_host", "inner_key").agg(
        F.flatten(F.collect_list("own")).alias("opened"),
        F.flatten(F.collect_list(F.when(F.col("host") != F.col("inner_host"), F.col("own")))).alias("closed"),
    )
    opening = stacks.select(F.col("inner_key").alias("key"), F.col("opened").alias("stack"))
    closing = stacks.select(F.expr(f"concat(substring(inner_key, 1, length(inner_key) - 1), '{END}')").alias("key"), F.col("closed").alias("stack"))
    return opening.unionByName(closing)


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[UrlRule] = RULES, *, default: str = "allow", lanes: int | None = None) -> DataFrame:
    """One row (page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule string wins; of equally long ones the longer host,
    then the smaller string, then block before allow. No rule: rule is null and verdict is `default`. Null
    urls and urls without '://' have an empty host and path and fit no rule.
    Repeated rows are judged each; further columns of pages, of whatever names,
    are left out.
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in rules])))
    lanes = lanes or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(rules).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), "key", F.lit(0).alias("is_url"), "stack",
        F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    urls = (
        pages.select("page_id", F.col("url").alias("__rf_url"))
        .select("page_id", url_parts(F.col("__rf_url")).alias("u"))
        .select("page_id", "u.host", "u.path")
        .select(F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).alias("lane"), host_key(F.col("host")).alias("key"), F.lit(1).alias("is_url"), F.lit(None).cast(bounds.schema["stack"].dataType).alias("stack"), "page_id", "host", "path")
    )
    order = Window.partitionBy("lane").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = urls.unionByName(bounds).withColumn("open", F.last("stack", ignorenulls=True).over(order)).where("is_url = 1")
    fits = F.expr("filter(open, r -> (host = r.host OR endswith(host, concat('.', r.host))) AND startswith(path, r.path))")
    ranked = F.expr("transform(__rf_fits, r -> struct(-length(r.host) - length(r.path) AS a, -length(r.host) AS b, concat(r.host, r.path) AS rule, if(r.verdict = 'block', 0, 1) AS c, r.verdict AS verdict))")
    best = F.when(F.size("__rf_fits") > 0, F.array_min(ranked))
    return (
        swept.withColumn("__rf_fits", fits)
        .withColumn("__rf_best", best)
        .select("page_id", "host", "path", F.col("__rf_best.rule").alias("rule"), F.coalesce("__rf_best.verdict", F.lit(default)).alias("verdict"))
    )


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, h, f) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (SELECT page_id, host, path, (SELECT struct_pack(rule := h || f, verdict := verdict) FROM r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
        ORDER BY length(h || f) DESC, length(h) DESC LIMIT 1) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""
