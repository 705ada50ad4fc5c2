import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    """A copy without them imports and has all its other queries; a fault within them isn't hidden."""
    import shutil

    shutil.copytree(ROOT / "almanac", tmp_path / "almanac", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fts_bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run().returncode == 0, run().stderr
    (tmp_path / "corpus_pipeline.py").write_text("import surely_missing\n")
    assert "surely_missing" in run().stderr


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "almanac").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "almanac.llm" not in path.read_text(), path
