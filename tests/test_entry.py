"""The entry module lists its queries before any session exists."""

import pathlib
import subprocess
import sys


def test_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = pathlib.Path(__file__).parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
