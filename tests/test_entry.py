"""The driver's contract, with and without the parts that may be taken away."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_pipeline_parts(tmp_path):
    shutil.copytree(ROOT / "claimflow", tmp_path / "claimflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"], said.stderr
    assert int(said.stdout.split()[0]) > 150


def test_an_error_inside_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "claimflow", tmp_path / "claimflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode and "not_there_at_all" in said.stderr
