"""The driver's entry works with the optional subpackage, without what it needs and without its folders."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import sys; sys.path.insert(0, {top!r}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in e.queries()))"
BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {module!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
"""


def counts(code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd="/", timeout=120)
    assert out.returncode == 0, out.stderr
    return [int(x) for x in out.stdout.split()]


def test_a_missing_library_costs_only_the_subpackage():
    core = counts(BLOCK.format(module="zstandard") + SHOW.format(top=TOP))
    assert core[0] >= 98 and core[1] >= 98 and core[2] <= 1  # the pipeline does without it


def test_without_the_folders(tmp_path):
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    core = counts(SHOW.format(top=str(tmp_path / "repo")))
    assert core[0] >= 98 and core[1] >= 98 and core[2] == 0


def test_the_core_imports_nothing_of_the_subpackage():
    code = f"import sys; sys.path.insert(0, {TOP!r}); from termweave import suite; from termweave.sources import catalog; from termweave.streaming import ingest; print(sum(m.startswith('termweave.llm') for m in sys.modules))"
    assert counts(code) == [0]
