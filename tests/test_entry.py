"""The entry points on a copy of the repository without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROBE = """
import tempfile
import __spark_entry__ as e
from custspark.session import local_session

names, sql = e.queries(), e.oracle_sql()
assert "kpi_summary" in names and set(sql) <= set(names)
assert not any(n.startswith("op") or n == "pipeline" for n in [*names, *sql])
spark = local_session(2, "entry", **{"spark.sql.warehouse.dir": tempfile.mkdtemp()})
assert len(e.entry(spark).collect()) == 4
spark.stop()
"""


def _probe(folder: Path, code: str) -> None:
    subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, timeout=300, env={**os.environ, "PYTHONPATH": str(folder)})


def test_entry_without_the_text_operators(tmp_path):
    """Without the folders, and with or without the pipeline's file beside them."""
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json")
    shutil.copytree(ROOT, copy, ignore=skip)
    assert not (copy / "custspark" / "llm").exists()
    # An earlier run's caches leave an empty folder behind.
    (copy / "custspark" / "llm" / "__pycache__").mkdir(parents=True)
    _probe(copy, PROBE)
    (copy / "corpus_pipeline.py").unlink()
    _probe(copy, "import __spark_entry__ as e; assert 'pipeline' not in e.queries()")
