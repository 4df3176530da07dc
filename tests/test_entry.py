"""The entry points, with and without the subpackage that may be left out."""

from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    got = entry.entry(spark)
    assert got.columns == ["o_orderkey", "o_totalprice", "customer", "nation"] and got.count() == 100


def test_the_rest_stands_alone():
    code = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("tessera.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
names = e.queries()
assert "flagship" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
