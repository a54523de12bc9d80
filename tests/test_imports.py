"""Every module imports alone, in a process of its own, in whatever order a user takes them."""

import pkgutil
import subprocess
import sys
from pathlib import Path

import pytest

import millrace

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(m.name for m in pkgutil.walk_packages(millrace.__path__, "millrace.") if not m.name.startswith("millrace.llm"))


@pytest.mark.parametrize("module", [*MODULES, "__spark_entry__"])
def test_imports_alone(module):
    done = subprocess.run([sys.executable, "-c", f"import {module}"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
