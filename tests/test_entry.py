"""The contract of __spark_entry__: names, shapes, and a repository that works without the training-data folder."""

import importlib
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark, small):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_training_data_folder():
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tidemark.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'p3_found' in e.queries() and 'p1_found' not in e.queries() and 'bm25_topk' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
