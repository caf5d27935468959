"""The corpus package is optional: without its folders the entry and everything else work."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("channel_signals/llm", "tests/llm"), ("channel_signals/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    skipped = shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse", "llm")
    shutil.copytree(REPO, copy, ignore=skipped)
    if "corpus_pipeline.py" in gone and (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "import tools.check_oracle, bench; "
            "assert len(q) > 80 and set(s) <= set(q) and 'pipeline' not in q, sorted(q); "
            "assert not any(n.startswith('op1_') for n in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
