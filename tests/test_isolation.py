"""The library without the training-data operators, which the driver may delete."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "repo", env=env, check=True)
    os.remove(tmp_path / "repo" / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "repo", env=env, check=True)
