"""The rest works where the llm subpackage and the pipeline were left out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "manifolder", tmp_path / "manifolder", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fuzzy_graph' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_the_rest_passes_without_llm(tmp_path):
    """Queries and their tests run in a copy without the two folders and the pipeline."""
    for name in ("manifolder", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for wanted in (["--collect-only", "tests"], ["tests/test_whole_table.py", "tests/test_neighbors.py", "-k", "whole or kernel or mutual or degree"]):
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *wanted], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stdout[-2000:]


def test_a_missing_library_is_an_error(tmp_path):
    """Only the two folders may lack: anything else that can't be imported shows."""
    shutil.copytree(ROOT / "manifolder", tmp_path / "manifolder", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_lacks")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "a_library_that_lacks" in done.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "manifolder").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "manifolder.llm" not in path.read_text(), path
