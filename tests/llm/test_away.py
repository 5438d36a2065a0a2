import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print([e.queries()[n](spark, {small!r}).count() > 0 for n in ("op2_warc", "op4_toxicity", "op5_neighbours", "op6_packing", "op7_secrets", "op8_simhash")])
"""


def test_workers_need_no_copy_of_the_package(small, tmp_path):
    """Python workers get the functions by value: here the package can't be imported there."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    code = CODE.format(repo=str(Path(__file__).resolve().parents[2]), small=small)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("[True, True, True, True, True, True]"), out.stderr[-2000:]
