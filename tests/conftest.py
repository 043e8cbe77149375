import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from txgraph.session import local_session

    s = local_session("*", shuffle_partitions=8, app="txgraph-tests")
    yield s


@pytest.fixture
def edges(spark):
    """Build an edge frame (src, dst, value) from a list of (src, dst) pairs."""

    def make(pairs, value=1):
        rows = [(int(a), int(b), value) for a, b in pairs]
        return spark.createDataFrame(rows, "src bigint, dst bigint, value bigint")

    return make
