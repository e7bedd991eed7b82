"""What the driver sees."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 14) if sum(k.startswith(f"op{n}_") for k in names) != 1] == []
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_in_the_library_imports_the_subpackage():
    for path in (ROOT / "sourceloom").rglob("*.py"):
        if path.parent.name != "llm":
            assert "sourceloom.llm" not in path.read_text(), path


def test_the_rest_works_without_it(tmp_path):
    for name in ("sourceloom", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name != "sourceloom" else (tmp_path / name).mkdir()
    for part in (ROOT / "sourceloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            os.symlink(part, tmp_path / "sourceloom" / part.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
