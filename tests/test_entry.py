"""The entry module imports without a session, with and without the llm folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q))"


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    n, known = said.stdout.split()
    assert known == "True"
    return int(n)


def test_entry_survives_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert names(copy) > 140
    assert names(ROOT) >= names(copy)
