import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cumulus.session import configure, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    session = configure(builder, 4).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    """(rows, labels) -> points table with ids from 0."""

    def make(rows, labels=None, parts=3):
        data = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "id bigint, x array<double>, label int").repartition(parts)

    return make
