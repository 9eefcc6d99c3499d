"""Without the training-data subpackage the registry imports, and has all other queries."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_without_the_subpackage(tmp_path):
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "moodtide").rglob("*.py"):
        if "llm" not in f.parts:
            assert "moodtide.llm" not in f.read_text(), f
