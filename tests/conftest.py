import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("lexmill-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Value of one column function for each of some texts."""
    from pyspark.sql import functions as F

    def run(step, *values, schema="id int, c string"):
        df = spark.createDataFrame(list(enumerate(values)), schema)
        rows = df.select("id", step(F.col("c")).alias("out")).orderBy("id").collect()
        return [row.out for row in rows]

    return run
