"""The jobs as queries: each runs twice into one new folder of the shared storage and gives what stands there then."""

from __future__ import annotations

from jobs import clearance, notes_profile
from rangeforge.sources.driver import POINTS
from rangeforge.sources.scratch import scratch_folder


def job1_notes_profile(spark, sf_dir):
    folder = scratch_folder(spark, "job1")
    for _ in range(2):
        out = notes_profile.run(spark, f"{sf_dir}/documents*.parquet", folder)
    return spark.read.schema(notes_profile.REPORT).parquet(out)


def job2_clearance(spark, sf_dir):
    folder = scratch_folder(spark, "job2")
    for _ in range(2):
        out = clearance.run(spark, f"{sf_dir}/lineitem.parquet", folder)
    return spark.read.schema(clearance.CLEARANCE).parquet(out)


QUERIES = {"job1_notes_profile": job1_notes_profile, "job2_clearance": job2_clearance}

ORACLE_SQL = {
    "job1_notes_profile": r"""
WITH w AS (SELECT doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN 'unknown' ELSE source END AS source, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'und' ELSE lang END AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM documents),
m AS (SELECT *, least(255, words // 8) AS level FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY level) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM m),
t AS (SELECT source, lang, greatest(4.0, 0.5 * (max(level) FILTER (i = floor(n * 0.3)::BIGINT) + max(level) FILTER (i = floor(n * 0.8)::BIGINT)))::DOUBLE AS threshold FROM o GROUP BY ALL)
SELECT lang, count(*) AS notes, sum(words)::BIGINT AS words, min(threshold) AS threshold, sum((level > threshold)::INT)::BIGINT AS long_notes, arg_max(doc_id, struct_pack(w := words, d := -doc_id)) AS longest_id, source
FROM m JOIN t USING (source, lang) GROUP BY source, lang
""",
    "job2_clearance": f"""
WITH {POINTS}, d AS (SELECT bag, frame_idx, trunc(f / 2.0)::INT AS d_bin, count(*) AS n FROM points WHERE f >= 0 AND f < 180 AND abs(lat) < 3.5 GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY bag, frame_idx ORDER BY d_bin) AS met FROM d),
s AS (SELECT bag, frame_idx, sum(n)::BIGINT AS points, min(d_bin) FILTER (met >= 3) AS stop FROM m GROUP BY ALL),
r AS (SELECT bag, frame_idx, coalesce(points, 0)::BIGINT AS points, coalesce(stop * 2.0, 180.0)::DOUBLE AS clearance FROM (SELECT DISTINCT bag, frame_idx FROM points WHERE bag IS NOT NULL AND frame_idx IS NOT NULL) LEFT JOIN s USING (bag, frame_idx)),
n AS (SELECT *, coalesce(lag(clearance) OVER o, clearance) AS a, coalesce(lead(clearance) OVER o, clearance) AS b FROM r WINDOW o AS (PARTITION BY bag ORDER BY frame_idx)),
x AS (SELECT *, list_sort([a, clearance, b])[2] AS smooth FROM n)
SELECT frame_idx, points, clearance, smooth, CASE WHEN smooth < 4 THEN 'alarm' WHEN smooth < 8 THEN 'warn' ELSE 'free' END AS level, bag FROM x
""",
}
