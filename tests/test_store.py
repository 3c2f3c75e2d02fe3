"""Places in the shared folder."""

import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from mustra.sources import store

REPO = Path(__file__).resolve().parents[1]


def test_places_are_gone_when_a_driver_ends_after_stopping_its_session(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
from mustra.sources.store import new_place
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
path = new_place(spark, "kind")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3
spark.stop()
print("written")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "written" in done.stdout, done.stderr[-2000:]
    for _ in range(100):
        if not list((tmp_path / "shared").glob("kind-*")):
            break
        time.sleep(0.2)
    assert (tmp_path / "shared").exists() and not list((tmp_path / "shared").glob("kind-*"))


def test_the_warehouse_is_shared_only_on_one_machine():
    def session(master, named=None):
        none = SimpleNamespace(isDefined=lambda: False)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
        known = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": "/warehouse"}
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, default=None: known[k]))

    assert store.shared_root(session("local")) == store.shared_root(session("local[8]")) == "/warehouse"
    assert store.shared_root(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            store.shared_root(session(master))
