import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from tracewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limit(spark):
    """Split keys above a handful of rows, so small data takes the path of huge keys."""
    spark.conf.set("spark.tracewell.hotRows", "5")
    yield
    spark.conf.unset("spark.tracewell.hotRows")
