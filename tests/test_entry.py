"""The driver's contract, and the library without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_subpackage(tmp_path):
    code = "import sys; sys.modules['lumenloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'windowhist_rate' in q and 'pipeline' not in q and 'op1_minhash' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "lumenloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "lumenloom.llm" not in p.read_text(), p
