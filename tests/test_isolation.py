"""The library works without the training-data subpackage."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "tagweave", tmp_path / "tagweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(q) == set(o) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
