"""The entry module without its optional part: the queries of the reference must remain."""

import subprocess
import sys

import pytest
from conftest import ROOT

from ledgerlens.plans.catalog import QUERIES

BLOCK = """
import importlib.abc, sys, warnings
class Blocked(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("blocked " + name)
sys.meta_path.insert(0, Blocked())
warnings.simplefilter("error" if {name!r} == "none" else "always")
import __spark_entry__ as e
print(len([q for q in e.queries() if q.startswith("q")]), len(e.queries()), len([q for q in e.oracle_sql() if q.startswith("q")]))
"""


def entry_with_blocked(name):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()], done.stderr


@pytest.mark.parametrize("name", ["tiktoken", "tokenizers", "xxhash", "ledgerlens.llm", "ledgerlens.llm.queries"])
def test_a_missing_module_leaves_the_other_queries(name):
    (q, all_, sql), said = entry_with_blocked(name)
    assert q == sql == len(QUERIES) >= 26
    if all_ == q:
        assert "is left out" in said


def test_a_missing_pipeline_leaves_the_operators():
    (q, all_, _), _ = entry_with_blocked("corpus_pipeline")
    (q2, all2, _), _ = entry_with_blocked("ledgerlens.llm")
    assert q == q2 == all2 == len(QUERIES) and all_ >= all2
