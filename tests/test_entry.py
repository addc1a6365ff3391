import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_stands_alone(tmp_path):
    """Without the text operators' folders, with and without the pipeline's file, all core queries are still there."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; from rasterloom import queries as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLE_SQL); print('ok')"
    for _ in range(2):
        got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert got.stdout.strip() == "ok", got.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
