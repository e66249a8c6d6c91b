"""The contract module without the subpackage's libraries."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(before: str) -> subprocess.CompletedProcess:
    code = f"import sys; sys.path.insert(0, {ROOT!r})\n{before}\nimport __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)


def test_a_missing_library_takes_only_its_own_queries():
    made = imported("sys.modules['ahocorasick'] = None; sys.modules['tiktoken'] = None; sys.modules['tokenizers'] = None")
    assert made.returncode == 0, made.stderr
    assert int(made.stdout.split()[0]) > 50


def test_all_queries_are_there():
    made = imported("")
    assert made.returncode == 0, made.stderr
