"""The driver contract: names, imports, and the guard around the llm subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    every = entry.queries()
    assert set(entry.oracle_sql()) <= set(every) and len(every) >= 30


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    for path in (ROOT / "basaltine").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_without_llm(tmp_path):
    """A copy without the subpackage and the pipeline still imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "basaltine", tmp_path / "basaltine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'query_memory' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True).returncode == 0


def _rows(frame):
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in row) for row in frame), key=str)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_oracle(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    place = [[d[0] for d in result.description].index(c) for c in columns]
    expected = [[row[k] for k in place] for row in result.fetchall()]
    frame = entry.queries()[name](spark, data)
    assert sorted(frame.columns) == columns
    assert _rows(frame.select(columns).collect()) == _rows(expected)
