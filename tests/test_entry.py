"""The entry works without the training-data operators, or without a library only they need."""

import subprocess
import sys

BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as e
from tidemark.plans import catalog
assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracle_sql())
"""


def test_blocked_imports():
    for name in ("zstandard", "tidemark.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], check=True, timeout=120)
