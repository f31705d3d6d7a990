"""Python workers find the package wherever the session was started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from perigon.operators import powerlaw
counts = spark.createDataFrame([(v,) for v in [1] * 30 + [2] * 12 + [3] * 5 + [7]], "n bigint")
print("FOUND", powerlaw.fit(counts).count())
"""


def test_a_session_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), master="local[2]")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 1" in done.stdout, done.stderr[-2000:]
