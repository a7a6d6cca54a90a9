"""Every query against its SQL on whole tables, and that the driver's entry works."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from fossick.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.schema.names)
    return names, Counter(zip(*[map(repr, table.column(c).to_pylist()) for c in names], strict=True))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toArrow()) == rows(duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["path", "n_lines", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_operators(tmp_path):
    """The rest imports and has its queries when their folders are gone, and those alone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    assert (tmp_path / "r/corpus_pipeline.py").exists() and not (tmp_path / "r/fossick/llm").exists()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))]
