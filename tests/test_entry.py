"""The entry file with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    return said.stdout.split()[2:]


def test_entry_without_optional_folders(tmp_path):
    """Whichever of the folder and the pipeline's file is missing, the library's own queries stay."""
    from flowplace.plans import catalog

    own = sorted(catalog.queries())
    shutil.copytree(ROOT / "flowplace", tmp_path / "flowplace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert names(tmp_path) == own
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    assert names(tmp_path) == own
