import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from marketlens.session import configure

    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate an expression over one row with the column ``x``."""
    from pyspark.sql import functions as F

    def run(make, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y

    return run
