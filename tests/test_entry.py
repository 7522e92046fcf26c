"""The entry without the optional operators, and when a library that they need is missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["sparkloom/llm"], ["sparkloom/llm", "corpus_pipeline.py"], []])
def test_entry_works_without(tmp_path, gone):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = tmp_path / "repo" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    block = "" if gone else "import sys; sys.modules['numpy'] = None; "
    code = f"{block}import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'graph_star' in q, any(n.startswith('op4_') for n in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1:] == ["True", "False", "False"] and int(done.stdout.split()[0]) > 100
