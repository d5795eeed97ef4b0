"""The driver contract, with and without the optional corpus part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"consumer_group", "vshard", "depth"}


def test_imports_without_the_corpus_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("logweir.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_part():
    others = [p for p in (ROOT / "logweir").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert others and not any("llm" in p.read_text() for p in others)
