"""The driver's entry works without the training-data package, its tests and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
names = set(e.queries())
assert "request_decision" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
assert not any(m.startswith("sluice.llm") or m == "corpus_pipeline" for m in sys.modules)
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_package(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: {n for n in names if n == "llm" or n.startswith(".git") or n == "__pycache__"})
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE, str(copy)], check=True, cwd=tmp_path, env=env, timeout=120)
