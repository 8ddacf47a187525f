"""The entry module and the other queries without the text preparation subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sorted(n for n in q if n.startswith('op') and n[2].isdigit()), 'pipeline' in q, set(s) <= set(q))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """Both folders deleted, with and without the pipeline's file."""
    from tidemark.plans import all_queries

    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "tests", *(() if pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    runs, sql = all_queries()
    assert done.stdout.strip() == f"{len(runs)} {len(sql)} [] False True", done.stderr
