import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from faultline.session import get_session

    s = get_session(master="local[*]", shuffle_partitions=8, app="faultline-tests")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SMALL
