import pytest

from tessella.session import session


@pytest.fixture(scope="session")
def spark():
    return session("tessella-tests", 8)
