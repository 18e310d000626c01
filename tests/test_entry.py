"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and callable(e.entry)


def test_entry_works_without_the_optional_parts(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'near_dedup' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_every_module_can_be_the_first_import():
    names = [".".join(p.relative_to(REPO).with_suffix("").parts).removesuffix(".__init__") for p in (REPO / "tributary").rglob("*.py") if "llm" not in p.parts]
    code = "import importlib, sys\nfor n in sys.argv[1:]:\n    [sys.modules.pop(m) for m in list(sys.modules) if m.startswith('tributary')]\n    importlib.import_module(n)"
    done = subprocess.run([sys.executable, "-c", code, *names], cwd=REPO, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
