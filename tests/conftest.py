import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from soundings.session import local_session

    s = local_session("4", "6g", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def middle():
    return f"{DATA}/sf0.01"
