"""The driver contract: every query against its SQL twin, and an import without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillon.plans import registry
from tests.conftest import ROOT

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def shown(rows):
    """Rows in an order that nulls don't upset, with floats rounded."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    frame = registry.QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == sorted(columns)
    rows = frame.select(*columns).collect()
    assert shown(rows) == shown(found.fetchall())


def test_entry(spark):
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and not any(n.startswith('op') for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=100)
    assert found.returncode == 0 and int(found.stdout) == len(registry.QUERIES), found.stderr
