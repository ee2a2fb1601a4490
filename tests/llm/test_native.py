"""URL rules, quality rules and exact dedup: SQL on the small tables, odd rows, and plans without Python."""

import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rangeforge.llm import quality_rules as q
from rangeforge.llm.exact_dedup import drop_exact_copies, exact_groups
from rangeforge.llm.queries import ORACLE_SQL, QUERIES
from rangeforge.llm.url_rules import RULES, UrlRule, judge_urls

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df, found = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", ["op1_url_rules", "op6_quality_rules", "op7_exact_dedup"])
def test_no_python_in_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://a.b.example.org/es/", "http://example.org/en/12?x", "http://notexample.org/es/", "http://org/", "http://x.org", "http://x.org?/es/",
    "http://x.com/fr/1#a", "http://x.com/de/", "http://x.com/", "http://example.org:80/es/", "a://b://example.org/es/", "http://\u0001a.example.org/es/", "http://example.org\u0000/es/", "http://.org/", "http://x.com/de/\n/fr/", "http://É.ORG/", "http://com/fr/" + "x" * 20000,
]


def plain_judge(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = "" if rest is None else re.match(r"[^/?#]*", rest)[0]
    path = "" if rest is None else re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_urls(spark):
    more = [UrlRule("block", "b.example.org", "/"), UrlRule("allow", "a.b.example.org", "/es/"), UrlRule("block", "co.uk", ""), UrlRule("allow", "uk", "")]
    urls = [*URLS, "http://x.co.uk", "http://y.uk/z", "http://co.uk"]
    rows = [(i, u, "h", 1) for i, u in enumerate(urls)] + [(None, "http://x.com/de/", None, None)] + [(4, urls[4], "h", 1)] * 300
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    for rules in (RULES, (*RULES, *more)):
        got = sorted(judge_urls(pages, rules, lanes=5).collect(), key=str)
        assert [tuple(r) for r in got] == sorted(((r[0], *plain_judge(r[1], rules)) for r in rows), key=lambda r: f"Row(page_id={r[0]}, host={r[1]!r}, path={r[2]!r}, rule={r[3]!r}, verdict={r[4]!r})")
    assert judge_urls(pages.limit(0)).count() == 0


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h i j", "x " * 30, "a b c d e " * 2, "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha beta gamma delta epsilon", "l1 words here\n" * 40, "A1 B2 CC DD EE FF GG HH II JJ KK",
    "é ß ü \u00a0 nbsp\u00a0stays one word for us all in all here", "# * $ % & | < > many marks here in a text of words", "w" * 300_000, " ".join(f"w{i}" for i in range(30_000)), "\n".join(["same", "other", "", "same", " same", "z z z z z z z z z z z"]),
]


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again = set(), set()
    for i in range(len(w) - 4):
        x = tuple(w[i : i + 5])
        (again if x in seen else seen).add(x)
    covered = {i + k for i in range(len(w) - 4) if tuple(w[i : i + 5]) in again for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
    caps = sum(not re.search(r"[a-zß-öø-ÿ]", x) and len(re.findall(r"[A-ZÀ-ÖØ-Þ]", x)) > 1 for x in w)
    return (*n, failed, not (failed or 100 * n[2] > 25 * n[0] or 2 * n[3] > len(lines) or 2 * caps > n[0]))


def test_quality(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[7], None, None), (7, TEXTS[7], 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = sorted((tuple(r) for r in q.measure_quality(docs).collect()), key=str)
    assert got == sorted(((r[0], *plain_counts(r[1])) for r in rows), key=str)
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if plain_counts(r[1])[-1])
    assert q.measure_quality(docs.limit(0)).count() == 0 and q.filter_quality(docs.limit(0)).count() == 0


def test_cascade_order(spark):
    docs = spark.createDataFrame([(i, "short" if i % 2 else "good words " + " ".join(f"w{k}" for k in range(40))) for i in range(100)], "doc_id long, text string")
    plan = q.plan_cascade(docs)
    assert plan[0]["rule"].name == "few_words" and plan[0]["rejects"] == 0.5
    assert [p["rejects"] / p["cost"] for p in plan] == sorted((p["rejects"] / p["cost"] for p in plan), reverse=True)


@pytest.mark.parametrize("salts", [1, 8])
def test_exact(spark, salts):
    rows = [(5, "a  b", 1), (3, "a\tb", 2), (9, "a b ", 3), (None, "a b", 4), (7, None, 5), (2, "", 6), (8, " ", 7), (None, "only null", 8), (None, "only null", 9), (3, "a b", 10), (11, "x" * 200_000, 11), (12, "x" * 200_000, 12)] + [(100 + i, "copy copy", i) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(4).cache()
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(re.sub(SPACE, " ", t or ""), []).append(d)
    got = exact_groups(docs, salts=salts).collect()
    assert len(got) == len(rows)
    for key, ids in groups.items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()]
        least = min((d for d in ids if d is not None), default=None)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {least} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [least]
    left = drop_exact_copies(docs, salts=salts)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_groups(docs.limit(0)).count() == 0


def test_exact_digests_that_stand_for_several_texts(spark):
    """Digests by length only, one of them in most rows: groups stay those of the texts."""
    texts = ["same"] * 3000 + ["tame"] * 5 + ["a b", "a\t\nb", "a  b", "", " ", None, "four", "longer text"]
    docs = spark.createDataFrame([(k if k % 7 else None, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, __rf_row long, __RF_DIGEST string")
    rows = lambda df: sorted(df.select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert rows(exact_groups(docs, digest=lambda n: F.length(n).cast("string"))) == rows(exact_groups(docs))
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(["same", "tame", left.where("text RLIKE '^a'").first()["text"], "", " ", "four", "longer text"])
