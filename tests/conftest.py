import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import build_session

    session = build_session("local[8]", 8, app="tests", driver_memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression on one row."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
