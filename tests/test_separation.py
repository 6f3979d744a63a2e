"""The rest works without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_everything_else_loads_without_them(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, sys; q = e.queries(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), any('llm' in m for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["False", "False"]
