"""The driver's contract, with and without the training-data operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "conv_id" in df.columns


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "talewright", tmp_path / "talewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'canonical_events' in q and not any(n.startswith('op1') for n in q); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "talewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
