import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    for p in HERE.iterdir():
        if p.name not in (".git", "tests", "corpus_pipeline.py"):
            shutil.copytree(p, tmp_path / p.name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if p.is_dir() else shutil.copy(p, tmp_path / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 25 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_every_query_has_a_name_and_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
