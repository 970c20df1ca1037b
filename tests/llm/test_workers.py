"""All queries run where workers can't import the package."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
def absent(_):
    import importlib.util
    yield importlib.util.find_spec("lexforge") is None
assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [True]
queries = __spark_entry__.queries()
for name in sorted(queries):
    if name == "pipeline" or name.startswith("op"):
        if name.startswith("optimize"):
            continue
        queries[name](spark, "/root/testdata/sf0.001").collect()
        print("ran", name)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("ran ") == 11
