import pytest

from archivolt.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
