"""The entry module without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "corpus_pipeline" or name.startswith("gaugeline.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as E
assert len(E.queries()) > 200 and set(E.oracle_sql()) <= set(E.queries())
assert not any(n.startswith("op") and n[2:3].isdigit() for n in E.queries()) and "pipeline" not in E.queries()
"""


def test_entry_without_training_data_operators():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
