"""The entry module on copies of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), 'pipeline' in q, sum(n[:2] == 'op' for n in q))"


@pytest.mark.parametrize("also_pipeline", [False, True])
def test_imports_without_the_training_operators(tmp_path, also_pipeline):
    leave = [".git", "__pycache__", ".pytest_cache", "llm"] + (["corpus_pipeline.py"] if also_pipeline else [])
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*leave))
    env = os.environ | {"PYTHONPATH": f"{copy}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, pipeline, operators = done.stdout.split()
    assert int(n) > 150 and (pipeline, operators) == ("False", "0")
