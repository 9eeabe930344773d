"""The entry module imports with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("gridlens.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=REPO, check=True)
