from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_llm_folders(tmp_path):
    for name in os.listdir(REPO):
        if name not in ("corpus_pipeline.py", "quantra", ".git"):
            (tmp_path / name).symlink_to(REPO / name)
    (tmp_path / "quantra").mkdir()
    for name in os.listdir(REPO / "quantra"):
        if name != "llm":
            (tmp_path / "quantra" / name).symlink_to(REPO / "quantra" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'm02_batch_quotations' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
