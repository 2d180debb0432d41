import pytest

from spendlake.session import local_session
from spendlake.sources.canonical import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "spendlake-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    return Tables(spark, SMALL)
