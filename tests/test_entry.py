"""The entry module without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"


def said(folder):
    run = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, check=True)
    return [int(n) for n in run.stdout.split()]


def test_entry_imports_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    bare = said(copy)
    assert bare[0] > 100 and bare[1:] == [0, 0]
    (copy / "trailmark" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    assert said(copy) == bare


def test_entry_imports_without_an_optional_package(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "zstandard.py").write_text("raise ImportError('no such package')")
    found = said(copy)
    assert found[0] > 100 and found[1] < 13 and found[2] == 0
