"""The library and its queries must work where the optional subpackage is deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 50 and not any(n.startswith("op") and n[2:3].isdigit() for n in names), sorted(names)
assert "pipeline" not in names and set(entry.oracle_sql()) <= set(names)
"""


def test_import_without_the_subpackage(tmp_path):
    for pipeline in (True, False):
        copy = str(tmp_path / f"copy-{pipeline}")
        os.makedirs(copy)
        shutil.copytree(os.path.join(ROOT, "rowlantern"), os.path.join(copy, "rowlantern"),
                        ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
        if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
