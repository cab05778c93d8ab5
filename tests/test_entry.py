"""The entry file works, also where the corpus operators were removed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 100


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quarry.llm" not in path.read_text(), path
