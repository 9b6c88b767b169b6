import pytest

from skein.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("skein-tests")
    yield session
    session.stop()
