import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bundlewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def make_logs(spark):
    def make(rows):
        """rows of (trace_id, timestamp, level, message); seq is the position"""
        data = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, "seq bigint, trace_id string, timestamp string, level string, message string")

    return make
