"""The entry module works without the optional training-data package, and does not hide its errors."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDE = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("workboard.llm"):
            raise {error}
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(len(e.queries()), "project_rollup" in e.queries(), any(n.startswith("op") for n in e.queries()), "pipeline" in e.oracle_sql())
"""


def _run(error):
    return subprocess.run([sys.executable, "-c", HIDE.format(error=error)], cwd=ROOT, capture_output=True, text=True)


def test_without_the_package():
    out = _run("ModuleNotFoundError(name, name=name)")
    assert out.returncode == 0, out.stderr
    n, rollup, ops, pipeline = out.stdout.split()
    assert int(n) > 40 and (rollup, ops, pipeline) == ("True", "False", "False")


def test_other_errors_are_not_hidden():
    assert _run("ImportError('broken')").returncode != 0
    assert _run("ModuleNotFoundError('numpyx', name='numpyx')").returncode != 0
