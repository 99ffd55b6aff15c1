"""The entry module with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return set(out.stdout.rpartition("NAMES")[2].split())


def test_other_queries_stand_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/lopside", tmp_path / "lopside", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    alone = names(tmp_path)
    assert len(alone) > 150 and not any(n.startswith("op") and n[2].isdigit() for n in alone) and "pipeline" not in alone
    if os.path.isdir(f"{ROOT}/lopside/llm"):
        assert alone < names(ROOT)
