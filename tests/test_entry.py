import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_core_stands_alone(tmp_path):
    """Without the corpus operators the rest imports and lists its queries."""
    shutil.copytree(ROOT / "waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_ip_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_a_missing_dependency_is_not_hidden(tmp_path):
    """Only the absence of the corpus operators themselves is passed over."""
    shutil.copytree(ROOT / "waymark", tmp_path / "waymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_dependency\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert got.returncode and "no_such_dependency" in got.stderr
    (tmp_path / "corpus_pipeline.py").write_text("from waymark.llm import dedup\n")
    subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, check=True)


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "waymark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "waymark.llm" not in path.read_text()
