import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]


@pytest.fixture(scope="session")
def spark():
    from envseries.session import local_session
    s = local_session("*", 8, app="envseries-tests")
    yield s
    s.stop()
