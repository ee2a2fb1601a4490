"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is run over a random sample of rows: the time it takes is its cost,
the share of rows it rejects its selectivity. Rules run in the order of
rejection per cost; a later rule is not evaluated for a row that an earlier one
rejected. The order never changes which rows are kept, so the sample may be
small and is bounded by SAMPLE_ROWS. Words are split once a row and given to all
rules.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table, text_or_empty, words_of

#: Rows from which costs and selectivities are estimated, about so many whatever the table's size; how often each is run for its time.
SAMPLE_ROWS, TIMES, SEED = 400, 8, 17
SYMBOLS = r"[#*$%&|<>]"


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeated(words: Column, width: int) -> Column:
    """Words that lie in a width-word window found at least twice: hashes of all windows, sorted with their places only where two are equal."""

    def places(s):
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p):
        steps = F.transform(p, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - v, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda s: let(places(s), covered)))

    # Words are hashed once, windows from the hashes of their words.
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)))


def n_capitals(text: Column) -> Column:
    """Words of two letters or more whose letters are all capitals."""
    return F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{Ll}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\x20\x09-\x0D]*(?![^\x20\x09-\x0D])")).cast("long")


@dataclass(frozen=True)
class Rule:
    """rejects: from a text and its words to boolean."""

    name: str
    rejects: object


RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 10),
    Rule("repeated_words", lambda t, w: 100 * _repeated(w, 5) > 20 * F.size(w)),
    Rule("symbols", lambda t, w: 100 * n_symbols(t) > 25 * F.size(w)),
    Rule("repeated_lines", lambda t, w: let(_lines(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("capitals", lambda t, w: 2 * n_capitals(t) > F.size(w)),
)


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules with their measured cost and selectivity, best rejection per cost first. An empty table keeps the given order."""
    n = docs.count()
    sample = cut(docs.where(F.rand(SEED) * n < sample_rows).select(text_or_empty().alias("t")).select("t", words_of(F.col("t")).alias("w")).coalesce(1))
    many = sample.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def run(rejects: Column) -> tuple[float, float]:
        best, share = float("inf"), None
        for _ in range(2):  # the first run also compiles
            started = time.perf_counter()
            share = many.agg(F.avg(rejects.cast("int"))).first()[0]
            best = min(best, time.perf_counter() - started)
        return best, share

    idle, none = run(F.length("t") < 0)
    if none is None:
        return [{"rule": r, "cost": 0.0, "rejects": 0.0} for r in rules]
    plan = []
    for r in rules:
        cost, share = run(r.rejects(F.col("t"), F.col("w")))
        plan.append({"rule": r, "cost": max(cost - idle, 1e-4), "rejects": share})
    return sorted(plan, key=lambda x: (-x["rejects"] / x["cost"], x["cost"], x["rule"].name))


def passes(text: Column, words: Column, plan: list[dict]) -> Column:
    """True where no rule rejects; the chain stops at the first rule that does."""
    verdict = F
    for step in plan:
        verdict = verdict.when(step["rule"].rejects(text, words), F.lit(False))
    return verdict.otherwise(F.lit(True)) if plan else F.lit(True)


def filter_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """Rows of docs, all columns as they are, whose text no rule rejects. Null and empty texts have no words and go."""
    plan = plan_cascade(docs, rules)
    return docs.where(let(words_of(text_or_empty()), lambda w: passes(text_or_empty(), w, plan)))


def measure_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of docs with its counts, base_failed and kept.

    Null texts count as empty, which fails the base rule (under ten words).
    Repeated rows give repeated results; other columns are left out.
    """
    plan = plan_cascade(docs, rules)
    rest = [step for step in plan if step["rule"].name not in ("few_words", "repeated_words")]

    def counts(w: Column) -> Column:
        return let(_repeated(w, 5), lambda r: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), r.cast("long").alias("n_repeat_words"),
            ((F.size(w) < 10) | (100 * r > 20 * F.size(w))).alias("base_failed"),
            F.when((F.size(w) < 10) | (100 * r > 20 * F.size(w)), F.lit(False)).otherwise(passes(F.col("__rf_t"), w, rest)).alias("kept"),
        ))

    t = F.col("__rf_t")
    base = docs.select("doc_id", text_or_empty().alias("__rf_t")).select("doc_id", "__rf_t", let(words_of(t), counts).alias("__rf_w"))
    return base.select("doc_id", "__rf_w.n_words", "__rf_w.word_chars", n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), "__rf_w.n_repeat_words", "__rf_w.base_failed", "__rf_w.kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 4], ' ')) AS n FROM g),
c AS (SELECT rid, count(DISTINCT i + k) AS r FROM h, range(0, 5) AS t(k) WHERE n > 1 GROUP BY rid),
f AS (SELECT doc_id, t, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{Ll}') AND regexp_matches(x, '\p{Lu}.*\p{Lu}'))) AS n_caps
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 25 * n_words) AND NOT (2 * n_dup_lines > len(l)) AND NOT (2 * n_caps > n_words) AS kept
FROM b
"""
