import pytest

from tapeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    yield s
    s.stop()
