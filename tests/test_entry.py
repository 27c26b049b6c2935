"""The entry takes the corpus package if it is there, and then its errors are errors."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)


def test_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT / "snapstats", tmp_path / "snapstats", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = run(tmp_path)
    assert done.returncode == 0 and done.stdout.split()[1] == "0", done.stderr


def test_a_broken_corpus_package_is_an_error(tmp_path):
    shutil.copytree(ROOT / "snapstats", tmp_path / "snapstats", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "snapstats/llm").mkdir()
    (tmp_path / "snapstats/llm/__init__.py").write_text("")
    (tmp_path / "snapstats/llm/registry.py").write_text("from snapstats.llm import nosuch\n")
    done = run(tmp_path)
    assert done.returncode != 0 and "nosuch" in done.stderr
