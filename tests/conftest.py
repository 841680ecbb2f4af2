import os

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])

from casefile.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(cores=8, memory="6g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
