"""The jobs: against SQL, on odd rows, over growing input, and rerun after a failure."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import clearance, notes_profile
from jobs.queries import ORACLE_SQL, QUERIES
from tests.test_catalog import canonical

SF = "/root/testdata/sf0.001"


def by_sql(name, **tables):
    duck = duckdb.connect()
    for table, path in tables.items():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    found = duck.execute(ORACLE_SQL[name])
    return [d[0] for d in found.description], found.fetchall()


def same(df, names, rows):
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r[n] for n in names) for r in df.collect()]) == canonical(rows)


@pytest.mark.parametrize(("name", "table"), [("job1_notes_profile", "documents"), ("job2_clearance", "lineitem")])
def test_query(spark, name, table):
    same(QUERIES[name](spark, SF), *by_sql(name, **{table: f"{SF}/{table}.parquet"}))


def rows_of(spark, out, schema):
    return spark.read.schema(schema).parquet(out)


def test_notes_grow(spark, tmp_path):
    """A second run takes only the new file, and the report is that of all notes; a batch that failed after it wrote isn't counted twice."""
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string, lang string, source string, n_chars long, batch long"
    first = [(i, f"word {i} " * (i % 40), "en", "a" if i % 3 else "b", 5, 1) for i in range(200)] + [(None, "no id", None, None, None, None), (7, None, "", " ", 0, 0), (8, "\t\n ", "de", "a", 0, 0), (9, "x " * 50_000, "de", "a", 0, 0), (9, "x " * 50_000, "de", "a", 0, 0)]
    second = [(1000 + i, "later note", "en", "c", 5, 1) for i in range(50)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(inbox)
    out = notes_profile.run(spark, inbox, folder)
    same(rows_of(spark, out, notes_profile.REPORT), *by_sql("job1_notes_profile", documents=f"{inbox}/*.parquet"))
    before = {f: os.path.getmtime(f"{folder}/measures/batch=0/{f}") for f in os.listdir(f"{folder}/measures/batch=0")}
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(inbox)
    for _ in range(2):
        out = notes_profile.run(spark, inbox, folder)
        same(rows_of(spark, out, notes_profile.REPORT), *by_sql("job1_notes_profile", documents=f"{inbox}/*.parquet"))
        assert before == {f: os.path.getmtime(f"{folder}/measures/batch=0/{f}") for f in os.listdir(f"{folder}/measures/batch=0")}
    # As after a loss between the writing of batch 1 and its mark: the batch is taken again and replaces itself.
    for f in ("1", ".1.crc"):
        os.remove(f"{folder}/progress/commits/{f}")
    out = notes_profile.run(spark, inbox, folder)
    same(rows_of(spark, out, notes_profile.REPORT), *by_sql("job1_notes_profile", documents=f"{inbox}/*.parquet"))


def test_notes_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    out = notes_profile.run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert rows_of(spark, out, notes_profile.REPORT).count() == 0


def test_clearance_rerun(spark, tmp_path):
    """Odd rows against SQL; a rerun over other recordings leaves those that it doesn't read."""
    schema = "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double, bag long"
    rows = [(f, b, float((f * 7 + k * 5) % 60), 0.05, 0.04, 1.0, 0) for f in range(30) for b in (1, 2) for k in range(f % 5)]
    rows += [(3, None, 1.0, 0.05, 0.04, 1.0, 0), (None, 2, 1.0, 0.05, 0.04, 1.0, 0), (35, 2, None, 0.05, 0.04, 1.0, 0), (36, 1, 5.0, None, None, None, None), (37, 1, 500.0, 0.05, 0.0, 0.0, 0)]
    table, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(table)
    for _ in range(2):
        clearance.run(spark, table, folder)
        same(rows_of(spark, folder, clearance.CLEARANCE), *by_sql("job2_clearance", lineitem=f"{table}/*.parquet"))
    other = str(tmp_path / "other")
    spark.createDataFrame([(1, 3, 9.0, 0.05, 0.04, 1.0, 0)] * 4, schema).write.parquet(other)
    before = rows_of(spark, folder, clearance.CLEARANCE).count()
    clearance.run(spark, other, folder)
    assert rows_of(spark, folder, clearance.CLEARANCE).count() == before + 1
    none = str(tmp_path / "none")
    clearance.run(spark, table, none, {"points_needed": 10**6})
    assert {r.clearance for r in rows_of(spark, none, clearance.CLEARANCE).collect()} == {180.0}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "nothing"))
    assert rows_of(spark, clearance.run(spark, str(tmp_path / "nothing"), str(tmp_path / "empty")), clearance.CLEARANCE).count() == 0
    with pytest.raises(ValueError, match="unknown settings: widht"):
        clearance.run(spark, table, none, {"widht": 1})


@pytest.mark.parametrize(("job", "table"), [("notes_profile", "documents"), ("clearance", "lineitem")])
def test_command_line(tmp_path, job, table):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", f"{SF}/{table}*.parquet", "--output", str(tmp_path / "out"), "--config", f"jobs/{job}.json"], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and json.load(open(f"{root}/jobs/{job}.json"))
    assert any(d.startswith(("source=", "bag=")) for d in os.listdir(tmp_path / "out" / ("report" if job == "notes_profile" else "")))
