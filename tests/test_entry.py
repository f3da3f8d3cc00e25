"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["customers_c_custkey", "customers_c_name", "orders_o_orderkey", "orders_o_totalprice"]


@pytest.mark.parametrize("left", [False, True])
def test_imports_without_the_corpus_operators(tmp_path, left):
    """`left`: a folder of compiled files stays behind."""
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / "millrace/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(catalogue.QUERIES)), "False"], done.stderr


@pytest.mark.parametrize("name", ["interval_join_lazy", "count_window_join", "distinct_time_window", "group_time_window", "event_log_counts"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    made = entry.queries()[name](spark, sf)
    columns = sorted(made.columns)
    tidy = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    got = sorted(str([tidy(r[c]) for c in columns]) for r in made.collect())
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(str([tidy(v) for v in r]) for r in expected)
