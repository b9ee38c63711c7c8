import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables_small(spark):
    from riskloom.sources.tables import Tables
    return Tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tables_check(spark):
    from riskloom.sources.tables import Tables
    return Tables(spark, SF_CHECK)
