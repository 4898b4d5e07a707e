"""Queries that run Python on executors work from any folder, without the package on the workers' path."""

import os
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", "%s")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "%s").getOrCreate()
print("ROWS", entry.queries()["state_verdicts"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_query_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT % (ROOT / "__spark_entry__.py", tmp_path / "shared")
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 1000" in out.stdout, out.stderr[-2000:]
