import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from wardline.operators import dense
print("ROWS", sorted(tuple(r)[:2] for r in dense.per_key(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), F.col("k")).collect()))
"""


def run(tmp_path, master):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, master=master)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS [('a', 2), ('b', 1)]" in done.stdout, done.stderr[-2000:]


def test_local_session_from_another_folder(tmp_path):
    run(tmp_path, "local[2]")
