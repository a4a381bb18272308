"""The driver's entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_operators(tmp_path):
    for left_out in (("llm", "corpus_pipeline.py"), ("llm",)):
        copy = tmp_path / str(len(left_out))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'c15_compare_summary' in q; print([x for x in q if x.startswith('op') or x == 'pipeline'])"
        got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert got.returncode == 0, got.stderr
        assert got.stdout.strip() == "[]"
