"""The driver contract works from any working directory: a plain session in a
fresh process outside the repo runs Python-backed queries (the workers import
the package shipped by ``ship_package``)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
for n in ("semantic_match", "ttl_counter"):
    print(n, E.queries()[n](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="tokenledger-cwd-")          # an empty folder outside the repo
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "semantic_match 500" in res.stdout and "ttl_counter 1000" in res.stdout
