import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Bounds so low that a handful of rows is cut, salted and spread like a huge table."""
    from foldsmith.operators import joins, neighbors, rank, similarity
    monkeypatch.setattr(joins, "HOT_SHARE", 3)
    monkeypatch.setattr(joins, "HOT_ROWS", 3)
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", 2)
