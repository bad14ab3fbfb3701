"""The entry works from another folder: workers get the package from the session."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {path!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for _ in range(2):
    print("rows", entry.queries()["retrieval_top1"](spark, "/root/testdata/sf0.001").count() > 0)
print("archives", sum(x.endswith("skydrift-package.zip") for x in spark.sparkContext.listFiles))
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(path=str(ROOT / "__spark_entry__.py"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows True\nrows True\narchives 1" in out.stdout, out.stderr[-2000:]
