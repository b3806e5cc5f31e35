"""Workers import the package whatever path the driver has."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import os, sys, tempfile
from pyspark.sql import SparkSession
new = lambda n: SparkSession.builder.master("local[2]").appName(n).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
spark = new("before")
spark.range(1).mapInArrow(lambda batches: batches, "id long").collect()  # workers run before the path is known
sys.path.insert(0, sys.argv[1])
os.environ["PYTHONPATH"] = sys.argv[1]
import __spark_entry__ as e
for session in (spark, spark.newSession()):
    for name in ("fetch_outcomes", "tex_encode", *sys.argv[3:]):
        assert e.queries()[name](session, sys.argv[2]).count() > 0
spark.stop()
again = new("after")
assert e.queries()["tex_encode"](again, sys.argv[2]).count() > 0
again.stop()
print("shipped")
"""


def test_workers_of_an_older_session_import_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.stdout.rstrip().endswith("shipped"), done.stderr[-2000:]
