import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    entry.ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make_points(spark):
    """Points table from a list of vectors (or of (dataset, id, vector))."""

    def build(rows, partitions=3):
        if not isinstance(rows[0], tuple):
            rows = [("all", i, x) for i, x in enumerate(rows)]
        data = [(d, i, [float(v) for v in x]) for d, i, x in rows]
        return spark.createDataFrame(data, "dataset_id string, point_id bigint, x array<double>").repartition(partitions)

    return build
