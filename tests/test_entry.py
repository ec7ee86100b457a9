"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

REPO = Path(__file__).resolve().parents[1]


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_works_without_llm(tmp_path):
    copytree(REPO, tmp_path / "repo", ignore=ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    rest = names(tmp_path / "repo")
    assert rest and not any(n.startswith("op") or n == "pipeline" for n in rest) and set(rest) <= set(names(REPO))


def test_nothing_else_imports_llm():
    for path in (REPO / "pairwright").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "pairwright.llm" not in path.read_text()


def test_entry(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
