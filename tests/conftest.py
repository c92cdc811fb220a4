import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

import support  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = support.local_session()
    session.sparkContext.setLogLevel("ERROR")
    return session
