import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from emberlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "0",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make lines from ``(source_ord, source, line, text)`` rows."""
    return lambda rows: spark.createDataFrame(rows, "source_ord int, source string, line bigint, text string")
