from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def seqs(spark):
    """A table of records from (header, seq)."""
    return lambda *rows: spark.createDataFrame([(k, h, s) for k, (h, s) in enumerate(rows, 1)], "seq_idx long, header string, seq string")
