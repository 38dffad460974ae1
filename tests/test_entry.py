"""The entry module must work from any folder, also in the Python workers of a stream."""

import os
import subprocess
import sys

import pytest

from __spark_entry__ import SMALL

SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("entry_module", {path!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", module.queries()["stream_player_state"](spark, {small!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")
def test_stream_from_another_folder(tmp_path):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(path=path, small=SMALL)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "rows 15" in done.stdout, done.stderr[-2000:]
