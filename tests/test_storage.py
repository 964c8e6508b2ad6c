"""Scratch tables go when they are released, or with the driver."""

import os
import subprocess
import sys
import time

from graphloom.functions import storage

SCRIPT = """
from pyspark.sql import SparkSession
from graphloom.functions.storage import stored
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{0}").getOrCreate()
assert stored(s.range(3), "numbers").count() == 3
import os
assert [n for n in os.listdir("{0}") if n.startswith("numbers-")]
"""


def test_tables_are_released(spark):
    df = storage.stored(spark.range(5), "five")
    path = storage._written[-1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    kept, storage._written[:] = storage._written[:-1], [path]  # tables of other tests may still be read
    assert storage.release(spark) == 1 and not os.path.exists(path) and storage._written == []
    storage._written[:] = kept


def test_tables_go_with_the_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [n for n in os.listdir(tmp_path) if n.startswith("numbers-")]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_stored_table_go_at_once(spark):
    before = shuffle_files(spark)
    df = storage.stored(spark.range(1000).groupBy("id").count(), "counts")
    end = time.time() + 20  # Spark removes them beside the driver's work
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and df.count() == 1000
    assert spark.conf.get(storage.CLEANUP, None) is None


def test_a_dropped_table_goes_and_others_stay(spark):
    df, other = storage.stored(spark.range(3), "three"), storage.stored(spark.range(4), "four")
    path = storage._paths[df]
    storage.drop(df, spark.range(2))
    assert not os.path.exists(path.removeprefix("file:")) and path not in storage._written and other.count() == 4
