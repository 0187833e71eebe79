import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
REFERENCE = ["file_inventory", "exact_dup_groups", "scan_summary", "report_summary", "scan_diff_groups", "scan_diff_counts", "near_dup_groups"]


@pytest.mark.parametrize("name", REFERENCE)
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, data)
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want, key=str) and want


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("sievelake", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "sievelake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e, sievelake.control as c; c.tool_specs(); q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1:] == ["False", "False"], out.stderr
