import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="etlspec-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("etlspec-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", os.path.join(work, "warehouse"))
        .config("spark.checkpoint.dir", os.path.join(work, "shared"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from rows and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


def collected(df, *order):
    """Rows as tuples, ordered by the given columns (or all), nulls first."""
    places = [df.columns.index(n) for n in order or df.columns]
    return sorted(map(tuple, df.collect()), key=lambda r: [(r[i] is not None, str(r[i])) for i in places])
