"""The driver contract."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import importlib.util
s = importlib.util.spec_from_file_location("entry", r"{root}/__spark_entry__.py")
m = importlib.util.module_from_spec(s)
s.loader.exec_module(m)
assert set(m.oracle_sql()) <= set(m.queries())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", m.entry(spark).count())
"""


def test_entry_runs_from_any_folder(tmp_path):
    """Tasks find the package although neither the folder nor PYTHONPATH leads to it."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("rows")[-1]) > 0
