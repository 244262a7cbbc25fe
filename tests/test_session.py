"""Queries run in a session the library did not create, from another
working directory (Python workers must import the shipped package)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as se
q = se.queries()
print("ROWS", q["o73_rate_limit"](spark, "/root/testdata/sf0.001").count(),
      q["o125_isolation_forest"](spark, "/root/testdata/sf0.001").count())
"""


def test_plain_session_from_other_directory():
    cwd = tempfile.mkdtemp(prefix="riskspark-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                       text=True, timeout=900)
    assert "ROWS 1000 6000" in r.stdout, r.stderr[-3000:]
