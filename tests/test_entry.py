import ast
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.plans.REGISTRY) > 40


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["question_id", "chunk_id"] and df.count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "lodeline").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def imported(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True)


def test_corpus_operators_can_be_removed_but_not_broken(tmp_path):
    for name in ("lodeline", "__spark_entry__.py", *(["corpus_pipeline.py"] if (ROOT / "corpus_pipeline.py").exists() else [])):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    llm = tmp_path / "lodeline" / "llm"
    if llm.exists():
        whole = imported(tmp_path)
        assert whole.returncode == 0
        (llm / "common.py").rename(llm / "uncommon.py")
        assert "lodeline.llm.common" in imported(tmp_path).stderr  # a broken import is not hidden
        shutil.rmtree(llm)
        # As the driver removes them: folder and pipeline.
        (tmp_path / "corpus_pipeline.py").unlink()
    bare = imported(tmp_path)
    assert bare.returncode == 0 and int(bare.stdout.split()[0]) == len(entry.plans.REGISTRY)
