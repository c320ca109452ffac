import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(params=[5, 512])
def listed(request):
    """Targets that a list of nearest targets may hold, few and many."""
    return request.param


@pytest.fixture(params=[0.0, 0.5, 0.9])
def floor(request):
    """Scores below which a similarity need not be exact."""
    return request.param
