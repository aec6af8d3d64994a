import pytest

from tessera.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, partitions=4)
    yield session
    session.stop()
