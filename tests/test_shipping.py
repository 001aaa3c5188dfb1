"""Python-worker code reaches executors without the package on their path."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print(q["score_udf"](spark, "/root/testdata/sf0.001").count(), q["scan_zip"](spark, "/root/testdata/sf0.001").count())
"""


def test_mapinpandas_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="pliego-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    a, b = map(int, out.stdout.strip().splitlines()[-1].split())
    assert a > 0 and b > 0
