import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from edgewright.session import local_session

    s = local_session(4, "tests", "4g")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edges_of(spark):
    def make(text: str, kind: str = "Calls"):
        """Edges written as `A>B`, or `A>B:Uses`."""
        rows = []
        for x in text.split():
            ends, _, t = x.partition(":")
            a, b = ends.split(">")
            rows.append((a, b, t or kind))
        return spark.createDataFrame(rows, "from_key string, to_key string, edge_type string")

    return make
