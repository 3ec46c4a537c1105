"""The package reaches Python workers of a session started from another folder."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from scoutgrid.session import get_spark
from scoutgrid.plans.queries import QUERIES
spark = get_spark("foreign", "local[2]", 2)
sys.path.remove({root!r})
print("rows", QUERIES["road_fields"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_find_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 10240" in done.stdout, done.stderr[-2000:]
    assert "Failed to compile" not in done.stderr
