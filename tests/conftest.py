import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("hexloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def cells(spark):
    from hexloom.plans import tables

    return tables.cells(spark, SF_DIR)


@pytest.fixture(scope="session")
def geometry(spark):
    from hexloom.plans import tables

    return tables.stored_geometry(spark, SF_DIR)


@pytest.fixture(scope="session")
def tile_index(spark):
    from hexloom.plans import tables

    return tables.stored_tile_index(spark, SF_DIR)


@pytest.fixture
def no_broadcast(monkeypatch, spark):
    """Pretend nothing fits a broadcast, so the other way is taken."""
    from hexloom.operators import joins

    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
