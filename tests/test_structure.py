"""The library without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_rest_stands_alone(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-*"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"], cwd=there, env={**os.environ, "PYTHONPATH": str(there)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split()[-2:] == ["False", "False"]


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "mnemoria")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                assert not re.search(r"(from|import) +mnemoria\.llm", open(os.path.join(folder, f)).read()), f
