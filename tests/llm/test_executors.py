"""Tasks run where executors have no copy of the repository: the driver stands in another folder."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r})
         .config("spark.sql.warehouse.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
made = entry.queries()
for name in sorted(entry.LLM):
    print(name, made[name](spark, {sf!r}).count(), flush=True)
"""


def test_every_operator_runs_from_a_foreign_folder(tmp_path, sf):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", CODE.format(root=root, shared=str(tmp_path / "shared"), sf=sf)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    assert len(out.stdout.split("\n")) >= 12
