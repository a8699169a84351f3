import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("bitcurve.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 150 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= names
"""


def test_the_rest_works_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_other_import_errors_are_not_hidden():
    broken = WITHOUT.split("import __spark_entry__")[0].replace('raise ModuleNotFoundError(f"No module named {name!r}", name=name)', 'raise ModuleNotFoundError("x", name="numpy")')
    run = subprocess.run([sys.executable, "-c", broken + "import __spark_entry__ as e\ne.queries()"], cwd=ROOT, capture_output=True, timeout=120)
    assert run.returncode != 0
