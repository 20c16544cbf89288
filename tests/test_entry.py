"""The entry points stand without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline'], sorted(q)"


@pytest.mark.parametrize("left", [None, "__pycache__", "broken"])
def test_queries_without_the_text_operators(tmp_path, left):
    """The folder away, a left-over folder, and a module that something is missing for."""
    shutil.copytree(ROOT / "quillspan", tmp_path / "quillspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "broken":
        (tmp_path / "quillspan/llm").mkdir()
        (tmp_path / "quillspan/llm/registry.py").write_text("import no_such_module\n")
    elif left:
        (tmp_path / f"quillspan/llm/{left}").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "quillspan").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quillspan.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
