import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory() as at:
        session = (
            SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "3")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
            .config("spark.checkpoint.dir", at).config("spark.sql.warehouse.dir", f"{at}/warehouse").getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
