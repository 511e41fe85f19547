"""Queries with executors in processes of their own, which see nothing of the driver's memory."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
from pyspark.sql import SparkSession
folder = sys.argv[1]
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m")
    .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
)
import __spark_entry__
for name in sys.argv[2:]:
    print("rows", name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_embedded_database_is_seen_by_executors(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(ROOT), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1"}
    got = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), "jdbc_whole", "jdbc_ranges", "jdbc_progressive_results"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    said = [x.split("rows ")[-1] for x in got.stdout.splitlines() if "rows jdbc" in x]
    assert said == ["jdbc_whole 25", "jdbc_ranges 18", "jdbc_progressive_results 3"], got.stderr[-2000:]
