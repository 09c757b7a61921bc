"""The entry must load in a process without a session, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOAD = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q); print(len(q), len(o))"


def test_entry_loads_without_a_session():
    done = subprocess.run([sys.executable, "-c", LOAD], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_loads_without_the_corpus_operators(tmp_path):
    for name in ("sparkway", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    for left_behind in (False, True):
        if left_behind:
            (tmp_path / "sparkway/llm/__pycache__").mkdir(parents=True)
        done = subprocess.run([sys.executable, "-c", LOAD + "; assert not [x for x in q if x.startswith('op') and x[2].isdigit() or x == 'pipeline']"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
