"""The registry, the SQL of the reference's queries, and the package without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from nearkin.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["group_id", "idx"] and df.count() > 0


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["box_downscale", "difference_hash", "laplacian_variance", "near_dup_groups_t3", "near_dup_pairs_t7", "candidate_stats", "scan_summary", "exif_date_le", "organize_plan", "organize_occupied", "path_rewrite"])
def test_sql(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not (ROOT / "nearkin" / "llm").exists(), reason="this is the copy, or the optional part is gone")
def test_without_the_optional_subpackage(tmp_path):
    """All other tests can be loaded, and those of the registry and the functions pass, with and without the pipeline's file."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    env = {"PATH": "/usr/bin:/bin"}
    code = "import __spark_entry__ as e; names = e.queries(); assert 'entry' not in names; print(len(names), len(e.oracle_sql()))"
    tests = [sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider"]
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "r" / "corpus_pipeline.py").unlink()
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=env, timeout=120)
        assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))], out.stderr
        found = subprocess.run([*tests, "--collect-only", "tests"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
        assert found.returncode == 0, found.stdout[-2000:]
    rest = subprocess.run([*tests, "tests/test_functions.py", "tests/test_entry.py"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=1200)
    assert rest.returncode == 0, rest.stdout[-2000:]
