"""The driver contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "colours" in out.columns


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/tilescope", tmp_path / "tilescope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'halve' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_the_rest_passes_without_the_subpackage(tmp_path):
    """With both folders and the pipeline gone, a part of the rest's own tests."""
    for folder in ("tilescope", "tests"):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    some = "test_query_matches_sql and (halve or sniff or folder_az or debounce) or form_a_group or oracle_has_a_query"
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-p", "no:cacheprovider", "-k", some], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0 and " passed" in run.stdout, run.stdout[-2000:]
