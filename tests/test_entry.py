"""The entry's queries where the training-data operators, or a library that they need, are missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

MISSING = """
import sys, warnings

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "xxhash" or name == "colonnade.llm" and hide_all:
            raise ImportError(f"no {name}")

hide_all = False
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    names = e.queries()
    assert "gt_f64" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
    assert set(e.oracle_sql()) <= set(names) and (seen or not e.importlib.util.find_spec("colonnade.llm"))
"""


def test_a_missing_library_leaves_the_base_queries():
    subprocess.run([sys.executable, "-c", MISSING], cwd=ROOT, check=True, timeout=120)
