"""The driver's module stands without the training-data operators and without what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "redgreen.llm", "corpus_pipeline"])
def test_queries_stand_without(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'flaky_occurrences' in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
