import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("postmatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("supplied tables are not here")
    return path


@pytest.fixture
def one(spark):
    """Evaluate one expression over one row of named text values."""

    def run(build, **values):
        names = list(values)
        schema = ", ".join(f"{name} string" for name in names) or "x string"
        row = tuple(values[name] for name in names) or ("",)
        return spark.createDataFrame([row], schema).select(build.alias("v")).first()["v"]

    return run
