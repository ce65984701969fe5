import pytest

from tidemark.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    from tidemark.plans.tables import Tables

    return Tables(spark, SF)
