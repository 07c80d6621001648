"""The library stands without the training-data subpackage, with or without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "foldsmith", tmp_path / "foldsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
