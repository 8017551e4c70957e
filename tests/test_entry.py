"""The driver contract, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quillbase import reference_queries

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(reference_queries.ORACLES) == set(reference_queries.QUERIES)


def test_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "quillbase", "tests"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillbase/llm"), str(tmp_path / "tests/llm")], check=True)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    done = run("-c", "import __spark_entry__ as e; print('join4' in e.queries(), any(k.startswith('op') for k in e.queries()), sorted(e.oracle_sql()) == sorted(e.queries()))")
    assert done.stdout.split() == ["True", "False", "True"], done.stderr
    done = run("-m", "pytest", "-q", "tests/test_sql.py", "tests/test_model.py", "tests/test_operators.py")
    assert done.returncode == 0, done.stdout


def test_an_error_within_the_operators_is_not_hidden(tmp_path):
    for name in ("__spark_entry__.py", "quillbase"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert "a_module_that_is_not_there" in done.stderr or not os.path.isdir(f"{REPO}/quillbase/llm")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(reference_queries.QUERIES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in reference_queries.TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = reference_queries.QUERIES[name](spark, SF)
    want = con.sql(reference_queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    own = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert own == sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 84
