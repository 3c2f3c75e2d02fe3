import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(place / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def stages(spark):
    """What a function's Spark stages read and shuffled: (input rows, shuffle bytes written) of each."""

    def of(run):
        store, java = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
        every = lambda: {s.stageId(): (s.inputRecords(), s.shuffleWriteBytes()) for s in java.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), None))}
        before = every()
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return [v for k, v in every().items() if k not in before]

    return of
