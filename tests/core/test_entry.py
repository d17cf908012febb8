"""The entry points: agreement with SQL, and independence from what can be taken away."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cdrlens import catalogue, queries

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple("-" if v is None or pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_like_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return plain(frame[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_only_the_entry_names_the_text_operators():
    for path in (ROOT / "cdrlens").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any(n == "llm" or n.startswith("cdrlens.llm") or n.startswith("llm.") for n in names), path


def test_entry_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "cdrlens", tmp_path / "cdrlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr


def test_flagship(spark):
    rows = queries.flagship(spark, SF).collect()
    assert len(rows) == 20 and {r.verdict for r in rows} >= {"out of scope"}


def test_lattice_of_the_registered_estimation():
    """The reference's urban configurations use 50 m; its LTE timing advance has rings of 78 m."""
    assert queries.SETTINGS.grid_m == 50.0
