"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"K", "precision", "recall", "f1"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    for part in ("recolumn", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(ROOT / part)
    code = """
import sys
class Gone:
    def find_spec(self, name, *_):
        if name.startswith("recolumn.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "popularity_metrics" in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
