"""The entry points without the llm subpackage, and without the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op1_') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("corpusloom/llm", "tests/llm"), ("corpusloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, with_sql, has_llm = said.stdout.split()
    from corpusloom.plans import ORACLES, QUERIES

    assert (int(n), int(with_sql), has_llm) == (len(QUERIES), len(ORACLES), "False")
