import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from funnelspark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "funnelspark-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def marts(spark):
    """Marts of the smallest test tables with the session table written once."""
    from funnelspark.plans.marts import Marts

    return Marts(spark, SF).share_sessions()


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
